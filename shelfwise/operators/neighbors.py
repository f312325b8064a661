"""Exact k-nearest neighbours (M6) by pivot cells and two rounds of visits.

Training rows are dealt to the nearest of about ``sqrt(rows) / 4`` pivots (their cell); a query's home is the
nearest pivot's cell, and queries of one home form blocks of bounded size. In the first round a query looks
into the nearest cells that hold ``k`` rows together, as a rule its home alone; the k-th distance
found bounds, by the triangle inequality, the other cells that can hold a neighbour, which the second
round visits. A table of (cell, query block) says which blocks visit a cell, and a training row goes
to those alone: queries that lie together share the cells they need. Blocks keep the k nearest of
their rows for each of their queries, and a ``row_number() <= k`` window (with a map-side group limit) merges them.

Copies of one vector are no burden: of equal training vectors only the ``k`` smallest ids can be
neighbours, and equal queries are answered once. Vectors that are null or hold null or non-finite
components take no part. Only pivots and cell bounds pass through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import shared_table

SPAN = 1 << 30
RESULT = "query_id long, neighbor_id long, dist2 double, neighbor_label double"


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _pivots(train: DataFrame, n: int, pivots: int) -> np.ndarray:
    """About ``pivots`` training vectors drawn by the hash of their id."""
    rate = min(SPAN, SPAN * pivots // max(n, 1) + 1)
    drawn = train.where(F.pmod(F.xxhash64("id"), F.lit(SPAN)) < F.lit(rate)).select("v").collect()
    drawn = drawn or train.select("v").limit(1).collect()
    return np.unique(np.array([r["v"] for r in drawn], np.float64), axis=0)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by one matrix product; good to about 1e-7 of the vectors' length, which the bounds allow for."""
    d2 = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d2, 0.0))


def _block_nearest(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, q = pdf[pdf["query"] == 0], pdf[pdf["query"] == 1]
        cols = ["query_id", "neighbor_id", "dist2", "neighbor_label"]
        if not len(t) or not len(q):
            return pd.DataFrame({c: np.empty(0, np.int64 if c.endswith("id") else float) for c in cols})
        t_ids, t_lab = t["id"].to_numpy(np.int64), t["label"].to_numpy(float)
        t_mat, q_mat = np.stack(t["v"].to_numpy()), np.stack(q["v"].to_numpy())
        # distances by one matrix product choose the candidates, with room for its rounding; theirs are then exact
        middle = t_mat.mean(axis=0)
        t_off, q_off = t_mat - middle, q_mat - middle
        t_2, q_2 = (t_off * t_off).sum(axis=1), (q_off * q_off).sum(axis=1)
        room = 1e-14 * (t_mat.shape[1] + 8) * (np.sqrt(q_2) + np.sqrt(t_2.max())) ** 2
        out = []
        for lo in range(0, len(q), 64):
            part = slice(lo, lo + 64)
            near = q_2[part, None] + t_2[None, :] - 2 * (q_off[part] @ t_off.T)
            kth = np.partition(near, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
            row, col = np.nonzero(~(near > (kth + room[part])[:, None]))
            d2 = ((q_mat[lo + row] - t_mat[col]) ** 2).sum(axis=1)
            order = np.lexsort((t_ids[col], d2, row))
            row, col, d2 = row[order], col[order], d2[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, d2 = row[kept], col[kept], d2[kept]
            out.append(pd.DataFrame({"query_id": q["id"].to_numpy(np.int64)[lo + row], "neighbor_id": t_ids[col], "dist2": d2,
                                     "neighbor_label": t_lab[col]}))
        return pd.concat(out)

    return run


def meetings(held: DataFrame, visits: DataFrame, parts: list[int]) -> DataFrame:
    """The rows that a round shuffles: every training row (``held``: id, v, label, cell) once for each query block that
    visits its cell, every query (``visits``: id, v, home, home_block, cell) once for each part of a cell it visits.
    ``parts``: of each cell."""
    blocks = visits.select("cell", "home", "home_block").distinct()
    n = F.get(F.lit(parts), F.col("cell").cast("int"))
    part = F.pmod(F.xxhash64("id"), n).cast("int")
    there = held.join(blocks, "cell").select(F.lit(0).alias("query"), "id", "v", "label", "cell", part.alias("part"), "home", "home_block")
    here = visits.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    here = here.select(F.lit(1).alias("query"), "id", "v", F.lit(0.0).alias("label"), "cell", "part", "home", "home_block")
    return there.unionByName(here)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist2", "neighbor_id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


class Cells:
    """Training vectors by cell, with the cells' sizes and radii."""

    def __init__(self, train: DataFrame, k: int, pivots: int | None, block_rows: int):
        self.k, self.block_rows, spark = k, block_rows, train.sparkSession
        # of equal vectors the k smallest ids; the group limit works before the shuffle
        alike = Window.partitionBy("v").orderBy("id")
        train = shared_table(train.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).drop("_r"))
        self.n = train.count()
        if not self.n:
            return
        points = _pivots(train, self.n, pivots or max(4, math.isqrt(self.n) // 4))
        self.book = book = spark.sparkContext.broadcast(points)

        def place(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), 512):
                    part = pdf.iloc[lo:lo + 512]
                    d = _distances(np.stack(part["v"].to_numpy()), book.value)
                    yield part.assign(cell=d.argmin(axis=1), dist=d.min(axis=1))

        self.held = shared_table(train.mapInPandas(place, "id long, v array<double>, label double, cell long, dist double"))
        sizes = self.held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"))
        count, radius = np.zeros(len(points), np.int64), np.zeros(len(points))
        for r in sizes.collect():  # a row for each pivot
            count[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
        slack = 1e-6 * float(np.sqrt((points * points).sum(axis=1)).max(initial=0.0)) + 1e-9
        self.count, self.radius, self.slack = count, radius + slack, slack
        self.parts = np.maximum(-(-count // block_rows), 1).tolist()

    def locate(self, queries: DataFrame) -> DataFrame:
        """(id, v, home, home_block, cells): ``cells`` are the nearest ones that hold k rows together."""
        count, k, n, book = self.count, self.k, int(self.count.sum()), self.book

        def run(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), 512):
                    part = pdf.iloc[lo:lo + 512]
                    d = np.where(count > 0, _distances(np.stack(part["v"].to_numpy()), book.value), np.inf)
                    order = np.argsort(d, axis=1)
                    before = np.cumsum(count[order], axis=1) - count[order]
                    needed = (before < min(k, n)).sum(axis=1)
                    yield part.assign(home=order[:, 0], cells=[o[:m] for o, m in zip(order, needed.tolist())])

        sent = shared_table(queries.mapInPandas(run, "id long, v array<double>, home long, cells array<long>"))
        # blocks of a home: as many as its queries fill
        blocks = [1] * len(self.parts)
        for r in sent.groupBy("home").count().collect():  # a row for each pivot
            blocks[r["home"]] = -(-r["count"] // self.block_rows)
        block = F.pmod(F.xxhash64("id"), F.get(F.lit(blocks), F.col("home").cast("int"))).cast("int")
        return sent.select("id", "v", "home", block.alias("home_block"), "cells")

    def reached(self, located: DataFrame) -> DataFrame:
        """``cells`` replaced by those not seen yet that can hold a row nearer than the k-th so far (column ``reach``)."""
        count, radius, slack, book = self.count, self.radius, self.slack, self.book

        def run(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), 512):
                    part = pdf.iloc[lo:lo + 512]
                    d = _distances(np.stack(part["v"].to_numpy()), book.value)
                    go = (d - radius <= part["reach"].to_numpy(float)[:, None] * (1 + 1e-9) + slack) & (count > 0)
                    for row, seen in zip(go, part["cells"]):
                        row[np.asarray(seen)] = False
                    yield part.assign(cells=[np.flatnonzero(g) for g in go]).drop(columns="reach")

        return located.mapInPandas(run, "id long, v array<double>, home long, home_block int, cells array<long>")

    def meet(self, located: DataFrame) -> DataFrame:
        visits = located.withColumn("cell", F.explode("cells")).drop("cells")
        work = meetings(self.held.drop("dist"), visits, self.parts)
        return work.groupBy("cell", "part", "home", "home_block").applyInPandas(_block_nearest(self.k), RESULT)


def nearest(train: DataFrame, query: DataFrame, k: int, vec: str, id_col: str, label: str,
            pivots: int | None = None, block_rows: int = 4096) -> DataFrame:
    """(query_id, neighbor_id, dist2, neighbor_label): the exact k nearest (Euclidean), ties to the smaller id."""
    spark = train.sparkSession
    t = train.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("double").alias("label"))
    q = query.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    cells = Cells(t.where(_usable(F.col("v"))), k, pivots, block_rows)
    q = q.where(_usable(F.col("v")))
    if not cells.n:
        return spark.createDataFrame([], RESULT)
    asked = q.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")  # equal queries once
    asked = cells.locate(asked)
    first = shared_table(_best(cells.meet(asked), k))
    reach = first.groupBy(F.col("query_id").alias("id")).agg(F.sqrt(F.max("dist2")).alias("reach"))
    second = cells.meet(cells.reached(asked.join(reach, "id").select("id", "v", "home", "home_block", "cells", "reach")))
    found = _best(first.unionByName(second), k)
    copies = q.withColumnRenamed("id", "own").join(asked.select("id", "v"), "v").select("own", "id")
    return copies.join(found, F.col("id") == F.col("query_id")).select(F.col("own").alias("query_id"), "neighbor_id", "dist2", "neighbor_label")


def knn(train: DataFrame, query: DataFrame, k: int = 5, vec: str = "embedding", id_col: str = "id",
        label: str = "label", task: str = "classify", pivots: int | None = None, block_rows: int = 4096) -> DataFrame:
    """M6: exact k nearest training rows (Euclidean) for every query row, then
    the majority label (ties -> smallest label) or the mean label.
    Output: id, prediction; queries without a usable vector have no row."""
    top = nearest(train, query, k, vec, id_col, label, pivots, block_rows)
    if task == "regress":
        pred = top.groupBy("query_id").agg(F.avg("neighbor_label").alias("prediction"))
    else:
        votes = top.groupBy("query_id", "neighbor_label").agg(F.count(F.lit(1)).alias("_n"))
        pred = votes.groupBy("query_id").agg(
            F.min(F.struct((-F.col("_n")).alias("k"), F.col("neighbor_label").alias("v")))["v"].alias("prediction"))
    return pred.withColumnRenamed("query_id", id_col)
