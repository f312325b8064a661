"""Nearest neighbours by inner product: one navigable small-world graph for each shard.

Vectors are dealt to shards by the hash of their id. A shard's task builds the layered graph
(Malkov and Yashunin) and stores it as one row of flat arrays: ids, vectors, levels and neighbour
lists of fixed width, -1 where empty. Query blocks then meet every shard's row, and the shard
results, ``k`` for each query, are merged into the nearest ``k``.

Largest inner product is turned into smallest distance by one more coordinate,
``sqrt(M^2 - |x|^2)`` with ``M`` the shard's longest norm, so graph and search are ordinary ones.
Scores are computed anew in double precision from the original vectors.

How it scales: a shard has a bounded number of rows, so build memory and time are bounded; a
search task holds one shard and one block of queries. The query set is stated (each
shard sees every block), and only ``k`` rows for each query and shard are shuffled.
"""

from __future__ import annotations

import heapq
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.session import shared_table


def usable(vector: str | Column) -> Column:
    """Not null, not empty, not zero, every component finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Graph:
    """The layered graph of one shard over flat neighbour arrays."""

    def __init__(self, vectors: np.ndarray, width: int = 16, ef_build: int = 80, seed: int = 7):
        n = len(vectors)
        self.width, self.ef_build = width, ef_build
        norm2 = np.einsum("ij,ij->i", vectors, vectors)
        self.top2 = float(norm2.max()) if n else 0.0
        extra = np.sqrt(np.maximum(self.top2 - norm2, 0.0))
        self.points = np.ascontiguousarray(np.column_stack([vectors, extra]), dtype=np.float32)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(width)).astype(np.int32), 12)
        upper = [np.full((int((self.level >= h).sum()), width), -1, np.int32) for h in range(1, int(self.level.max(initial=0)) + 1)]
        self.links = [np.full((n, 2 * width), -1, np.int32), *upper]
        self.slot = [np.arange(n), *[np.cumsum(self.level >= h) - 1 for h in range(1, len(self.links))]]
        self.entry, self.height = -1, -1
        self.seen = np.zeros(n, np.int64)
        self.stamp = 0
        for i in range(n):
            self._insert(i)

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.points[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _neighbours(self, i: int, h: int) -> np.ndarray:
        row = self.links[h][self.slot[h][i]]
        return row[row >= 0]

    def _descend(self, q: np.ndarray, low: int) -> int:
        """Greedy walk from the entry down to layer ``low``."""
        at, best = self.entry, float(self._distances(q, np.array([self.entry]))[0])
        for h in range(self.height, low, -1):
            while True:
                near = self._neighbours(at, h)
                if not len(near):
                    break
                d = self._distances(q, near)
                j = int(d.argmin())
                if d[j] >= best:
                    break
                at, best = int(near[j]), float(d[j])
        return at

    def _beam(self, q: np.ndarray, entry: int, ef: int, h: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest points found from ``entry`` on layer ``h``, nearest first."""
        self.stamp += 1
        seen, stamp, links, slot = self.seen, self.stamp, self.links[h], self.slot[h]
        seen[entry] = stamp
        d0 = float(self._distances(q, np.array([entry]))[0])
        todo, found = [(d0, entry)], [(-d0, entry)]
        while todo:
            d, at = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= ef:
                break
            near = links[slot[at]]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            dist = self._distances(q, near)
            if len(found) >= ef:
                closer = dist < -found[0][0]
                near, dist = near[closer], dist[closer]
            for x, v in zip(dist.tolist(), near.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (-x, v))
                    heapq.heappush(todo, (x, v))
                elif x < -found[0][0]:
                    heapq.heapreplace(found, (-x, v))
                    heapq.heappush(todo, (x, v))
        return sorted((-x, v) for x, v in found)

    def _spread(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of ``ids`` (nearest first): those nearer to the point than to any chosen one
        come first, the nearest others fill the rest, so dense groups keep links to the outside."""
        if len(ids) <= most:
            return ids
        p = self.points[ids]
        sq = np.einsum("ij,ij->i", p, p)
        among = sq[:, None] + sq[None, :] - 2.0 * (p @ p.T)
        near = np.full(len(ids), np.inf)
        chosen, left = [], []
        for i in range(len(ids)):
            if dist[i] < near[i]:
                chosen.append(i)
                near = np.minimum(near, among[i])
                if len(chosen) == most:
                    break
            else:
                left.append(i)
        chosen += left[: most - len(chosen)]
        return ids[chosen]

    def _insert(self, i: int) -> None:
        q, top = self.points[i], int(self.level[i])
        if self.entry < 0:
            self.entry, self.height = i, top
            return
        at = self._descend(q, min(top, self.height))
        for h in range(min(top, self.height), -1, -1):
            found = self._beam(q, at, self.ef_build, h)
            at = found[0][1]
            dist = np.array([d for d, _ in found])
            ids = np.array([v for _, v in found], np.int32)
            mine = self._spread(ids, dist, self.width)
            self.links[h][self.slot[h][i], : len(mine)] = mine
            for v in mine.tolist():
                row = self.links[h][self.slot[h][v]]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                    continue
                # full: keep a spread three quarters, so that the next links find room
                all_ids = np.append(row, np.int32(i))
                d = self._distances(self.points[v], all_ids)
                order = np.argsort(d, kind="stable")
                keep = self._spread(all_ids[order], d[order], len(row) * 3 // 4)
                row[:] = -1
                row[: len(keep)] = keep
        if top > self.height:
            self.entry, self.height = i, top

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Positions of about the ``k`` points of largest inner product with ``q`` (its length changes no order)."""
        if self.entry < 0:
            return np.empty(0, np.int64)
        q = np.append(q, 0.0).astype(np.float32)
        size = float(np.sqrt(q @ q))
        if size > 0 and self.top2 > 0:  # same scale as the points: rounding stays small
            q *= np.float32(math.sqrt(self.top2) / size)
        at = self._descend(q, 0)
        return np.array([v for _, v in self._beam(q, at, max(ef, k), 0)], np.int64)

    def to_bytes(self) -> bytes:
        """Flat arrays, one after another."""
        head = struct.pack("<qqqqqd", len(self.level), self.points.shape[1], self.width, self.entry, self.height, self.top2)
        return b"".join([head, self.level.tobytes(), self.points.tobytes(), *[x.tobytes() for x in self.links]])

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        g = cls.__new__(cls)
        n, dim, g.width, g.entry, g.height, g.top2 = struct.unpack_from("<qqqqqd", data)
        at = struct.calcsize("<qqqqqd")

        def take(count, kind):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        g.level = take(n, np.int32)
        g.points = take(n * dim, np.float32).reshape(n, dim)
        g.links = [take(n * 2 * g.width, np.int32).reshape(n, 2 * g.width)]
        for h in range(1, int(g.level.max(initial=0)) + 1):
            rows = int((g.level >= h).sum())
            g.links.append(take(rows * g.width, np.int32).reshape(rows, g.width))
        g.slot = [np.arange(n), *[np.cumsum(g.level >= h) - 1 for h in range(1, len(g.links))]]
        g.seen, g.stamp = np.zeros(n, np.int64), 0
        return g


def build_index(
    df: DataFrame, id_col: str, vector_col: str, shard_rows: int = 16384, least_shards: int = 8, width: int = 16, ef_build: int = 80
) -> DataFrame:
    """``(shard, dim, ids, starts, vectors, graph)``: one row for each shard and vector length, arrays as binary columns.

    Equal vectors of a shard are one point of its graph; ``ids`` lists the points' rows one after
    another, each point's by id, and ``starts`` where they begin. Unusable vectors and rows
    without id are left out.
    """
    rows = df.filter(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    shards = max(least_shards, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("dim", F.size("v"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        point_of: dict[bytes, int] = {}
        point = np.array([point_of.setdefault(v.tobytes(), len(point_of)) for v in pdf["v"]])
        order = np.argsort(point, kind="stable")
        starts = np.searchsorted(point[order], np.arange(len(point_of) + 1))
        vectors = np.stack(pdf["v"].to_numpy())[order[starts[:-1]]]
        graph = Graph(vectors, width, ef_build)
        return pd.DataFrame(
            {
                "shard": [pdf["shard"].iloc[0]],
                "dim": [pdf["dim"].iloc[0]],
                "ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()],
                "starts": [starts.astype(np.int64).tobytes()],
                "vectors": [vectors.tobytes()],
                "graph": [graph.to_bytes()],
            }
        )

    built = rows.repartition(shards, "shard", "dim").groupBy("shard", "dim")
    return shared_table(built.applyInPandas(build, "shard long, dim int, ids binary, starts binary, vectors binary, graph binary"))


def search(
    index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 20, ef: int = 160, block_rows: int = 1024
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each usable query, itself (by id) left out.

    Nearest first, ties to the smaller id; every shard, small or large, is searched through its
    graph. Vectors of other lengths than the query's take no part. A repeated query row
    is searched once.
    """
    q = queries.filter(usable(vector_col) & F.col(id_col).isNotNull())
    q = q.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = q.dropDuplicates(["query_id", "v"])
    q = q.withColumn("dim", F.size("v"))
    last, shards = index.agg(F.max("shard"), F.count("*")).first()
    blocks = max(1, math.ceil(q.count() / block_rows))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    each = q.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))))
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def find(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(shard) and len(block):
            one = shard.iloc[0]
            ids, starts = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["starts"], np.int64)
            vectors = np.frombuffer(one["vectors"], np.float64).reshape(len(starts) - 1, -1)
            graph = Graph.from_bytes(one["graph"])
            for query, v in zip(block["query_id"], block["v"]):
                v = np.asarray(v, np.float64)
                at = graph.search(v, k + 1, ef)
                exact = np.einsum("ij,j->i", vectors[at], v)
                near = np.lexsort((at, -exact))[: k + 1]  # points are numbered by their smallest id
                rows = [(ids[starts[at[j]] : min(starts[at[j] + 1], starts[at[j]] + k + 1)], exact[j]) for j in near]
                who = np.concatenate([r for r, _ in rows])
                score = np.concatenate([np.full(len(r), x) for r, x in rows])
                who, score = who[who != query], score[who != query]
                top = np.lexsort((who, -score))[:k]
                out.append((np.full(len(top), query), who[top], score[top]))
        if not out:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    tasks = max(1, min(shards * blocks, 10_000))
    keys = ["shard", "block", "dim"]
    found = (
        parts.repartition(tasks, *keys)
        .groupBy(*keys)
        .cogroup(each.repartition(tasks, *keys).groupBy(*keys))
        .applyInPandas(find, "query_id long, vec_id long, score double")
    )
    # at most k rows for each query and shard meet here
    by_score = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, ef: int = 160, **build) -> DataFrame:
    """Build the index over ``df`` and search it; see :func:`build_index` and :func:`search`."""
    return search(build_index(df, id_col, vector_col, **build), queries, id_col, vector_col, k, ef)
