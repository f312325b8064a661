"""Target-distribution importance resampling with hashed n-gram features.

Features of a text are its runs of 1 to ``run`` words, hashed into buckets by CRC-32. One pass counts
the buckets of the raw table, one those of the target; a bucket's gain is the smoothed log ratio
of its shares, in whole thousandths. A document's weight is the mean gain of its features, read
from an array; its score adds a Gumbel draw that follows from its id, so the best scores are a sample
without replacement in proportion to ``exp(weight)``. Ranks come from a distributed radix sort.

How it scales: two narrow passes over whole texts (counting, then weighing), whose results are
``buckets`` rows and one short row a document; the sort moves the short rows a few times. Nothing
depends on how often a word occurs: counts are summed in the tasks first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches
from shelfwise.llm.radix_sort import ranked
from shelfwise.session import shared_table

#: Words of UTF-8 bytes: ASCII letters and digits, and all that is not ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(texts: list[bytes | None], run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, the text of each, and the word counts.

    The checksum of a longer run goes on from that of its first words.
    """
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]  # bytes: A-Z only
    sizes = np.array([len(w) for w in found], np.int64)
    words = [w for ws in found for w in ws]
    doc = np.repeat(np.arange(len(texts)), sizes)
    sums = list(map(crc32, words))
    all_sums, all_docs = [np.array(sums, np.int64)], [doc]
    for n in range(2, run + 1):
        if len(words) < n:
            break
        sums = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), sums)))
        inside = doc[n - 1 :] == doc[: 1 - n]
        all_sums.append(np.array(sums, np.int64)[inside])
        all_docs.append(doc[n - 1 :][inside])
    return np.concatenate(all_sums) % buckets, np.concatenate(all_docs), sizes


def bucket_counts(df: DataFrame, text_col: str = "text", run: int = 2, buckets: int = 10_000) -> list[int]:
    """How many features of all texts fall into each bucket; the driver gets ``buckets`` numbers."""
    small_batches(df.sparkSession, rows=1000, size="4194304")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            held += np.bincount(features(b.column(0).to_pylist(), run, buckets)[0], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    parts = df.select(F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(count, "bucket long, n long")
    out = [0] * buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    raw_all, target_all, n = sum(raw), sum(target), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (raw_all + n) / ((s + 1) * (target_all + n)))) for s, t in zip(raw, target)], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, id_col: str, text_col: str, run: int) -> DataFrame:
    """``(id_col, n_words, n_features, weight)`` of every row; no features: weight 0."""
    small_batches(df.sparkSession, rows=1000, size="4194304")
    sent = df.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            bucket, doc, words = features(b.column(1).to_pylist(), run, len(table))
            order = np.argsort(doc, kind="stable")
            total = np.concatenate(([0], np.cumsum(table[bucket[order]])))
            n = np.bincount(doc, minlength=len(words))
            ends = np.cumsum(n)
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)  # whole numbers: rounds down, exactly
            yield pa.record_batch([b.column(0), pa.array(words), pa.array(n, pa.int64()), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])

    texts = df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("t"))
    return texts.mapInArrow(weigh, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that follows from seed and id (null: the empty id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    run: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    digit_bits: int = 12,
    block_rows: int = 200_000,
) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)`` of every row of ``df``.

    ``rank`` is 1, 2, 3, ... by falling score, ties by id, for the drawn: ``percent`` of the rows with
    ``least_words`` words, rounded down; null for all others. Null texts have no words, repeated rows are
    rows of their own (equal in all but the rank), null ids come last among ties, other columns are
    not read, an empty table gives no rows; an empty target leaves the smoothing alone. ``id_col`` is an integer column.
    """
    gain = gains(bucket_counts(df, text_col, run, buckets), bucket_counts(target, target_col, run, buckets))
    rows = weighed(df, gain, id_col, text_col, run)
    rows = shared_table(rows.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)))
    able = rows.filter(F.col("n_words") >= least_words).drop("n_words")
    drawn = able.count() * percent // 100
    order = ranked(able, [("score", False), (id_col, True)], "rank", digit_bits, block_rows)
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest)
