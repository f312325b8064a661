"""Lexical retrieval packing: windows filled with BM25 neighbours.

Documents are encoded once into a table. Its document frequencies, document count and mean
length are those of BM25 for the whole corpus. A tree of principal directions, grown on a
hash-drawn sample of projected idf vectors, numbers its leaves so that lexically near
documents get near numbers; ranges of leaves are dealt to partitions (a crowded leaf is cut by
a hash) and gathered there, in leaf order, into shards of a bounded number of tokens. A seed
document opens a window; its best-scoring unused neighbours of the shard, by BM25 over all of
the seed's terms, fill it in rank order, and the one that does not fit is cut there, its rest
being the next seed. So every window is full; what a shard leaves open goes on to the next
shard of the partition, and the last open window is cut at powers of two, which need no padding.

How it scales: one pass that encodes, one that counts (its result is bounded by the vocabulary
and sent to the tasks), one range shuffle of the ids; memory is bounded by a shard (and by the
longest document); a task lost with its executor is packed again alike, its rows being sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import gathered, small_batches
from shelfwise.llm.tokens import encoder
from shelfwise.session import shared_table

K1, B = 1.2, 0.75
ENCODE_BYTES = 16 << 20  # texts that are encoded together: the more, the more of their words repeat
_DIM = 48  # coordinates of a projected document
_SAMPLE = 16384  # documents that the tree is grown on, at least; 16 for each leaf
_DEPTH = 14  # levels of the tree, at most; beyond as many leaves a hash of the row cuts them


@dataclass
class Stats:
    """Document count, mean length and document frequency of each token id."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, term: np.ndarray) -> np.ndarray:
        df = self.df[term]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


class Bm25:
    """Inverted index over the token ids of a shard's documents, postings as flat arrays.

    Weights follow ``stats`` of the corpus; without them the documents are the corpus.
    """

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None):
        n = self.n = len(docs)
        lens = np.array([len(d) for d in docs])
        key = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), lens)
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(np.append(at, len(key)))
        term, doc = np.divmod(key[at], n)
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.append(start, len(term)))
        idf = stats.idf(term[start]) if stats else np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lens / max(stats.mean if stats else lens.mean(), 1e-9))
        self.term_of = np.repeat(np.arange(len(df)), df)
        self.impact = idf[self.term_of] * tf * (K1 + 1) / (tf + norm[doc])
        self.start, self.doc = np.append(start, len(term)), doc
        shared = np.flatnonzero(df[self.term_of] > 1)  # a term of one document finds no neighbour
        self.by_doc = shared[np.argsort(doc[shared], kind="stable")]
        self.doc_start = np.searchsorted(doc[self.by_doc], np.arange(n + 1))
        common = np.flatnonzero(df * 8 > n)  # rows of their own, added without a scatter
        self.row_of = np.full(len(df), -1)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n))
        row = self.row_of[self.term_of]
        self.rows[row[row >= 0], doc[row >= 0]] = self.impact[row >= 0]

    def scores(self, d: int, terms: int | None = None) -> np.ndarray:
        """BM25 of every document for all terms of document ``d``, or its ``terms`` weightiest."""
        own = self.by_doc[self.doc_start[d] : self.doc_start[d + 1]]
        if terms is not None and len(own) > terms:
            own = own[np.argpartition(self.impact[own], -terms)[-terms:]]
        own = self.term_of[own]
        row = self.row_of[own]
        rare, row = own[row < 0], row[row >= 0]
        s = np.zeros(self.n)
        for r in row.tolist():
            s += self.rows[r]
        if len(rare):
            size = self.start[rare + 1] - self.start[rare]
            at = np.arange(size.sum()) + np.repeat(self.start[rare] - (np.cumsum(size) - size), size)
            s += np.bincount(self.doc[at], self.impact[at], self.n)
        return s


def _ranked(index: Bm25, d: int, alive: np.ndarray, head: int = 32) -> Iterator[int]:
    """Unused documents by score, ties by position; most windows need only the first few."""
    s = np.where(alive, index.scores(d), -1.0)
    left = int(alive.sum())
    if left > head:
        top = np.argpartition(-s, head)[:head]
        top = top[np.lexsort((top, -s[top]))]
        # a tie with the cut's score may have a smaller position outside: such go to the full order
        sure = top[s[top] > s[top].min()]
        yield from sure.tolist()
        skip = len(sure)
    else:
        skip = 0
    yield from np.argsort(-s, kind="stable")[skip:left].tolist()


def pack_shard(docs: list[tuple[np.ndarray, int]], window: int, stats: Stats | None = None) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Full sequences of ``(doc, start, length)`` pieces, and the ``(doc, start)`` rests of the open one.

    ``docs`` are ``(ids, start)``: tokens before ``start`` are packed already. ``stats``: see :class:`Bm25`.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    if not docs:
        return sequences, []
    index = Bm25([ids[at:] for ids, at in docs], stats)
    used = [at for _, at in docs]
    size = [len(ids) for ids, _ in docs]
    alive = np.ones(len(docs), bool)
    seed, tail = 0, None
    while True:
        if tail is None:
            while seed < len(docs) and not alive[seed]:
                seed += 1
            if seed == len(docs):
                return sequences, []
            d = seed
        else:
            d, tail = tail, None
        alive[d] = False
        while size[d] - used[d] >= window:
            sequences.append([(d, used[d], window)])
            used[d] += window
        rest = size[d] - used[d]
        if not rest:
            continue
        pieces, free = [(d, used[d], rest)], window - rest
        for v in _ranked(index, d, alive):
            take = min(free, size[v] - used[v])
            pieces.append((v, used[v], take))
            used[v] += take
            free -= take
            alive[v] = False
            if used[v] < size[v]:
                tail = v
            if not free:
                break
        if free:
            return sequences, [(v, at) for v, at, _ in pieces]
        sequences.append(pieces)


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut one open window into sequences whose lengths are falling powers of two."""
    out, pieces = [], list(pieces)
    total = sum(n for _, _, n in pieces)
    for bit in reversed(range(total.bit_length())):
        need = (1 << bit) & total
        one = []
        while need:
            d, at, n = pieces.pop(0)
            take = min(need, n)
            one.append((d, at, take))
            need -= take
            if take < n:
                pieces.insert(0, (d, at + take, n - take))
        if one:
            out.append(one)
    return out


def corpus_stats(encoded: DataFrame) -> Stats:
    """BM25 statistics of all documents of a table with a column ``ids_``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(0, np.int64), 0, 0
        for b in batches:
            for ids in _arrays(b.column(0)):
                if int(ids.max()) >= len(df):
                    df = np.append(df, np.zeros(int(ids.max()) + 1 - len(df), np.int64))
                df[_distinct(ids)] += 1
                n, tokens = n + 1, tokens + len(ids)
        term = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [n, tokens]))], names=["term", "n"])

    counted = encoded.select("ids_").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counted.collect()}  # a row for each token id
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Stats(n, tokens / max(n, 1), df)


class Tree:
    """Median splits along principal directions: near vectors reach near leaf numbers."""

    def __init__(self, vectors: np.ndarray, depth: int):
        self.depth = depth
        self.direction = np.zeros(((1 << depth), _DIM), np.float32)
        self.cut = np.zeros(1 << depth, np.float32)
        parts = {1: vectors}
        for node in range(1, 1 << depth):  # the children of a node are 2 * node and 2 * node + 1
            v = parts.pop(node)
            if len(v) > 1:
                centred = v - v.mean(axis=0)
                self.direction[node] = np.linalg.eigh((centred.T @ centred).astype(np.float64))[1][:, -1]
                self.cut[node] = np.median(v @ self.direction[node])
            right = v @ self.direction[node] > self.cut[node]
            parts[2 * node], parts[2 * node + 1] = v[~right], v[right]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        node = np.ones(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", vectors, self.direction[node]) > self.cut[node])
        return node - (1 << self.depth)


def _as_bytes(lists: pa.ListArray) -> pa.Array:
    """The ids of each row as bytes, which Spark copies whole: two for an id if all of the batch fit, else
    four and one more byte for the row, so the length tells which."""
    ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
    if not len(ids) or ids.max() < 1 << 16:
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(2 * ends), pa.py_buffer(ids.astype("<u2"))])
    return pa.array([ids[a:z].astype("<i4").tobytes() + b"\0" for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row of a list column, or of one of :func:`_as_bytes`."""
    if pa.types.is_list(column.type):
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield flat[a:z]
        return
    for row in column:
        held = row.as_buffer()
        yield np.frombuffer(held, "<i4", held.size // 4) if held.size % 2 else np.frombuffer(held, "<u2")


def _distinct(ids: np.ndarray) -> np.ndarray:
    """The different ids in order."""
    ids = np.sort(ids)
    return ids[np.append(True, ids[1:] != ids[:-1])]


def _projected(docs: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """One unit vector for each document: its distinct terms' idf rows, summed."""
    out = np.stack([np.add.reduce(signs.take(_distinct(ids), axis=0)) for ids in docs])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def by_likeness(encoded: DataFrame, stats: Stats, partitions: int) -> DataFrame:
    """``encoded`` dealt to ``partitions`` ranges of leaves and sorted by leaf; its columns ``id_`` and ``ids_`` stay, its
    ``salt_``, a hash of both, goes.

    The shares of the leaves in the sample say which partitions a leaf fills; where these are several,
    a hash of the row cuts it. So a row's partition follows from the row and nothing is counted or sampled again.
    """
    noise = np.random.default_rng(11).standard_normal((len(stats.df), _DIM))
    signs = (stats.idf(np.arange(len(stats.df)))[:, None] * noise).astype(np.float32)
    depth = min(_DEPTH, max(0, (4 * partitions - 1).bit_length()))
    wanted = max(_SAMPLE, 16 << depth)
    rate = min(1.0, wanted / max(stats.n, 1))
    drawn = encoded.filter(F.pmod("salt_", F.lit(1 << 31)) < int(rate * (1 << 31)))
    sent = encoded.sparkSession.sparkContext.broadcast(signs)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = _projected(list(_arrays(b.column(0))), sent.value)
                yield pa.record_batch([pa.array(list(v), pa.list_(pa.float32())), b.column(1)], names=["v", "n"])

    # a text that a third of all rows share is one point of the tree, with its weight
    sample = drawn.groupBy("ids_").agg(F.count(F.lit(1)).alias("n")).mapInArrow(project, "v array<float>, n long").collect()
    sample = sorted((tuple(r.v), r.n) for r in sample)
    points = np.array([v for v, _ in sample], np.float32).reshape(-1, _DIM)
    grown = Tree(points, depth)
    share = np.bincount(grown.leaves(points), [n for _, n in sample], 1 << depth) + 1e-9
    share = share / share.sum()
    tree = encoded.sparkSession.sparkContext.broadcast((grown, share, np.cumsum(share) - share))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, width, begin = tree.value
        for b in batches:
            if len(b):
                leaf = leaves.leaves(_projected(list(_arrays(b.column(1))), sent.value))
                salt = b.column(2).to_numpy()
                place = begin[leaf] + width[leaf] * ((salt & 0xFFFFFF) / (1 << 24))
                part = np.clip((place * partitions).astype(np.int32), 0, partitions - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64()), pa.array(part)], names=[*b.schema.names, "leaf_", "part_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    placed = encoded.mapInArrow(assign, f"{fields}, leaf_ long, part_ int")
    dealt = placed.repartitionById(partitions, F.col("part_")).sortWithinPartitions("leaf_", "salt_")
    return dealt.select("id_", "ids_")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    shard_tokens: int = 2_000_000,
    shard_docs: int = 4096,
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    A document is the ids of its whole text and ``end_id`` (null text: only that id). Every id
    lies in exactly one piece; ``offset`` is the piece's place in its sequence, without gaps.
    Sequences hold ``window`` ids or a power of two, so none needs padding. Repeated rows are
    separate documents, null ids pass through, other columns are not read, an empty table
    gives no rows. ``tokenizer_path`` must be readable on the executors. Neighbours are searched
    in the shard, which holds likely ones from the whole table.
    """
    small_batches(df.sparkSession, rows=1000)
    fields = f"{id_col} {df.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        fields, names = fields + ", ids array<int>", [*names, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40  # sequence ids of a partition follow on it
        made, kind = 0, None
        held: list[tuple] = []  # (id, ids, start)
        tokens = 0

        def table(sequences) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            for pieces in sequences:
                place = 0
                for d, at, n in pieces:
                    key, ids, _ = held[d]
                    part = ids[at : at + n].astype("<i4")
                    row = [key, at, n, zlib.crc32(part), len(ids), first + made, place]
                    for c, x in zip(cols, row + [part] * keep_ids):
                        c.append(x)
                    place += n
                made += 1
            kinds = [kind, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def close() -> pa.RecordBatch:
            nonlocal held, tokens
            sequences, rest = pack_shard([(ids, at) for _, ids, at in held], window, sent.value)
            out = table(sequences)
            held = [(held[d][0], held[d][1], at) for d, at in rest]
            tokens = sum(len(ids) - at for _, ids, at in held)
            return out

        for b in batches:
            kind = b.column(0).type
            for key, ids in zip(b.column(0).to_pylist(), _arrays(b.column(1))):
                ids = ids.copy()  # not the whole batch
                held.append((key, ids, 0))
                tokens += len(ids)
                if tokens >= shard_tokens or len(held) >= shard_docs:
                    yield close()
        if held:
            yield close()
        if held:
            yield table(_powers([(i, at, len(ids) - at) for i, (_, ids, at) in enumerate(held)]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for b in gathered(batches, ENCODE_BYTES):
            ids = encode.lists(b.column(1), end_id)
            yield pa.record_batch([b.column(0), ids, _as_bytes(ids)], names=["id_", "list_", "ids_"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kept = src.mapInArrow(encoded, f"id_ {df.schema[id_col].dataType.simpleString()}, list_ array<int>, ids_ binary")
    coded = shared_table(kept.select("id_", "ids_", F.xxhash64("id_", "list_").alias("salt_")))
    stats = corpus_stats(coded)
    sent = df.sparkSession.sparkContext.broadcast(stats)
    # a quarter more than needed: a range that runs over would end in a small shard
    partitions = math.ceil(1.25 * max(stats.n * stats.mean / shard_tokens, stats.n / shard_docs))
    dealt = by_likeness(coded, stats, partitions) if partitions > 1 else coded.repartition(1).sortWithinPartitions("salt_").drop("salt_")
    return dealt.mapInArrow(run, fields)
