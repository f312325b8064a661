"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints within ``max_bits`` of each other are linked without a miss. Bit ``i`` gets
a non-zero vector ``m(i)`` of ``max_bits + 1`` bits; table ``v`` (one for each non-zero
``v`` of as many bits) keeps the bits with odd ``<m(i), v>``. The differing bits of a
pair, at most ``max_bits``, span fewer than ``max_bits + 1`` dimensions, so some ``v`` is
orthogonal to all of them and its table shows the pair equal keys.

How it scales: texts never leave the scan (one narrow pass turns each into 8 bytes);
equal fingerprints collapse to one row before any table is built; a table's buckets are
streamed in key order, compared with numpy blocks and reduced to spanning links, never
to all pairs. Buckets beyond ``bucket_rows`` are not held: their members are linked
instead through the midpoints of a pair (each fingerprint with up to ``max_bits / 2``
bits flipped), which is exact and linear in the number of members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches
from shelfwise.llm.components import connected_components
from shelfwise.session import shared_table

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one text (null or without words: 0).

    ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at the six ASCII blanks.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces], dtype="<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # a very long text is counted block by block
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """``(id, fp)``: the signed 64-bit pattern of each row's fingerprint, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def covering_masks(max_bits: int) -> list[int]:
    """One 64-bit mask for each table, as signed longs."""
    n = (1 << (max_bits + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        bits = sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def _spanning(fp: np.ndarray, rep: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket as (rep, smallest rep reachable inside the bucket)."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
    label = rep
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    far = label != rep
    return rep[far], label[far]


def _bucket_links(max_bits: int, bucket_rows: int):
    """Streams rows sorted by (table, key); keeps one bucket of at most ``bucket_rows`` rows.

    Yields links ``(rep, other, null)`` of small buckets and ``(rep, null, fp)`` for each
    member of a larger one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key, held_n, hot = None, 0, False
        out: list[tuple] = []

        def emit(rep, other, fp):
            out.append((rep, other, fp))

        def close():
            nonlocal held, held_n, hot
            if not hot and held_n > 1:
                fp = np.concatenate([x for x, _ in held])
                rep = np.concatenate([x for _, x in held])
                a, b = _spanning(fp, rep, max_bits)
                if len(a):
                    emit(a, b, None)
            held, held_n, hot = [], 0, False

        def add(fp, rep):
            nonlocal held, held_n, hot
            held_n += len(fp)
            held.append((fp, rep))
            if hot or held_n > bucket_rows:
                for f, r in held:
                    emit(r, None, f)
                held, hot = [], True

        def flush():
            rows = [
                pa.record_batch(
                    [
                        pa.array(r),
                        pa.nulls(len(r), pa.int64()) if o is None else pa.array(o),
                        pa.nulls(len(r), pa.int64()) if f is None else pa.array(f.view(np.int64)),
                    ],
                    names=["src", "dst", "hot"],
                )
                for r, o, f in out
            ]
            out.clear()
            return rows

        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(0).to_numpy(zero_copy_only=False)
            key = b.column(1).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            rep = b.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            lo = np.concatenate(([0], cut))
            hi = np.concatenate((cut, [len(t)]))
            # inside the batch only runs of two rows or more matter; the first and last may go on
            for j in np.flatnonzero((hi - lo > 1) | (lo == 0) | (hi == len(t))).tolist():
                a, z = int(lo[j]), int(hi[j])
                here = (int(t[a]), int(key[a]))
                if here != held_key:
                    close()
                    held_key = here
                add(fp[a:z], rep[a:z])
            yield from flush()
        close()
        yield from flush()

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 4, bucket_rows: int = 1024) -> DataFrame:
    """Spanning links ``(src, dst)`` between the ``rep`` values of ``fps(fp, rep)``.

    ``fp`` must be distinct. Two reps are connected by links exactly if their fingerprints
    are connected by steps of at most ``max_bits`` bits.
    """
    masks = covering_masks(max_bits)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select(F.explode(keys).alias("k"), "fp", "rep").select("k.t", "k.key", "fp", "rep")
    found = (
        rows.repartition("t", "key")
        .sortWithinPartitions("t", "key")
        .mapInArrow(_bucket_links(max_bits, bucket_rows), "src long, dst long, hot long")
    )
    found = shared_table(found.distinct())
    links = found.filter("hot IS NULL").select("src", "dst")
    hot = found.filter("hot IS NOT NULL").select(F.col("src").alias("rep"), F.col("hot").alias("fp"))
    # pairs of large buckets: equal after at most ceil(max_bits / 2) flips on either side. At
    # most 2,081 fingerprints (64 bits, two flips) can share a midpoint, so its list is bounded.
    half, rest = (max_bits + 1) // 2, max_bits // 2
    if hot.isEmpty():
        return links

    def variants(flips: int):
        masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in itertools.combinations(range(64), n)]
        return F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]))

    def midpoints(flips: int):
        d = hot.select("rep", "fp", variants(flips).alias("flip"))
        return d.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "rep")

    if half == rest:
        met = midpoints(half).groupBy("mid").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
        low = met.select(F.explode("reps").alias("src"), F.array_min("reps").alias("dst"))
    else:  # odd distances: one side flips one bit more
        near = midpoints(rest).select("mid", F.col("rep").alias("dst"))
        low = midpoints(half).join(near, "mid").select(F.col("rep").alias("src"), "dst")
    return links.unionByName(low.filter("src <> dst").distinct())


def simhash_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    bucket_rows: int = 1024,
) -> DataFrame:
    """``(id_col, fp, component_id)``, one row for each input row.

    ``component_id`` is the smallest id reachable by links of at most ``max_bits`` bits, its
    own included. Null or wordless texts have fingerprint 0 and link like any other. A
    row without id keeps its fingerprint, links with nothing and has a null component.
    Repeated rows come back repeated; other columns of ``df`` are not read.
    """
    fps = shared_table(fingerprints(df, id_col, text_col, shingle))
    reps = shared_table(fps.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    comps = connected_components(fingerprint_links(reps, max_bits, bucket_rows))
    named = reps.join(comps, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_")
    )
    named = shared_table(named)
    joined = fps.join(named, F.col("fp") == F.col("fp_"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "fp",
        F.when(F.col("id").isNotNull(), F.col("component_")).alias("component_id"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``df`` with one row of each near-duplicate class: the one with the smallest id.

    Of rows that repeat that id, one stays (the smallest by content hash). Rows without
    an id link with nothing and all stay.
    """
    from pyspark.sql import Window as W

    own = "kept_id_"
    while own in df.columns:
        own += "_"
    kept = simhash_classes(df, id_col, text_col, shingle, max_bits).filter(F.col(id_col) == F.col("component_id"))
    kept = shared_table(kept.select(F.col(id_col).alias("kept_id_")).distinct()).toDF(own)
    one = W.partitionBy(id_col).orderBy(F.xxhash64(*df.columns), text_col)
    mine = df.join(kept, F.col(id_col) == F.col(own), "left_semi")
    mine = mine.withColumn(own, F.row_number().over(one)).filter(F.col(own) == 1).drop(own)
    return mine.unionByName(df.filter(F.col(id_col).isNull()))
