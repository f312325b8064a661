"""Embedding near-duplicates through an inverted multi-index.

The unit vectors' halves have independent codebooks; a pair of codewords is a cell of the
product grid, and every vector lives in the cell of its nearest codewords. From a vector the
cells are visited nearest first, in the order of the multi-sequence algorithm (Babenko and
Lempitsky): the sum of the two halves' lower bounds on the distance to the cell. A visit ends
where a partner at the threshold is expected with the target recall: the reach is measured on
a sample, as that quantile of the bound to the cell of a partner at exactly the threshold.
Pairs that meet in a cell are verified by their cosine in double precision.

How it scales: equal vectors collapse first; a visit carries the vector to a few cells out of a grid
that grows with the table, so cells keep a bounded mean size. A cell with more rows is cut into
blocks, and each pair of blocks is one bounded piece of work. Links are counted inside the
blocks and only spanning links are emitted, never all pairs of a group.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import connected_components
from shelfwise.llm.hnsw import usable
from shelfwise.session import shared_table


class Grid:
    """Codebooks of the two halves and the reach of a visit."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        parts = [sample[:, : self.half], sample[:, self.half :]]
        self.books = [_codebook(p, words, rng) for p in parts if p.shape[1]]
        self.size = [len(b) for b in self.books]
        self.between = [_squares(b) for b in self.books]
        # partners at exactly the threshold, in random directions
        noise = rng.normal(size=sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        partner = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * noise
        bounds = sum(b[np.arange(len(sample)), w] for b, w in zip(self.bounds(sample), self.words(partner)))
        # no partner is farther than the chord, so the reach never has to exceed it
        self.reach = min(float(np.quantile(bounds, recall)), 2 - 2 * threshold) + 1e-9

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = [x[:, : self.half], x[:, self.half :]]
        return [(p * p).sum(axis=1)[:, None] - 2 * p @ b.T + (b * b).sum(axis=1) for p, b in zip(parts, self.books)]

    def words(self, x: np.ndarray) -> list[np.ndarray]:
        """Nearest codeword of each half."""
        return [d.argmin(axis=1) for d in self._distances(x)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for w, n in zip(self.words(x), self.size):
            out = out * n + w
        return out

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared lower bounds on the distance to each codeword's region: to the plane midway
        between it and the nearest codeword."""
        out = []
        for d, squares in zip(self._distances(x), self.between):
            home = d.argmin(axis=1)
            between = squares[home]
            gap = np.maximum(d - d[np.arange(len(x)), home][:, None], 0.0)
            out.append(np.divide(gap * gap, 4 * between, out=np.zeros_like(gap), where=between > 1e-18))
        return out

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells to visit from each row, home first, by rising bound."""
        all_bounds = self.bounds(x)
        if len(all_bounds) == 1:
            return [np.flatnonzero(b <= self.reach)[np.argsort(b[b <= self.reach], kind="stable")] for b in all_bounds[0]]
        orders = [np.argsort(b, axis=1, kind="stable") for b in all_bounds]
        return [
            _multi_sequence(all_bounds[0][i][orders[0][i]], all_bounds[1][i][orders[1][i]], orders[0][i], orders[1][i], self.size[1], self.reach)
            for i in range(len(x))
        ]


def _squares(book: np.ndarray) -> np.ndarray:
    sq = (book * book).sum(axis=1)
    return np.maximum(sq[:, None] + sq[None, :] - 2 * book @ book.T, 0.0)


def _multi_sequence(a: np.ndarray, b: np.ndarray, order_a: np.ndarray, order_b: np.ndarray, width: int, reach: float) -> np.ndarray:
    """Cells ``(i, j)`` by rising ``a[i] + b[j]`` up to ``reach``; ``a`` and ``b`` rise.

    Row ``i`` waits until ``(i - 1, j)`` was taken, so the heap holds one entry for each row begun.
    """
    out, heap = [], [(float(a[0] + b[0]), 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > reach:
            break
        out.append(int(order_a[i]) * width + int(order_b[j]))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(a[i + 1] + b[0]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))
    return np.array(out, np.int64)


def _codebook(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Plain k-means on the sample's distinct half vectors."""
    x = np.unique(x, axis=0)
    book = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((book * book).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        full = count > 0
        book[full] = total[full] / count[full][:, None]
    return book


def _block_links(home: pd.DataFrame, guest: pd.DataFrame, threshold: float):
    """Links between residents of a cell and visitors to it.

    Returns positions ``(h, g)`` of the pairs. A vector visits its own cell as well, so pairs of
    one cell are met from both sides like all others.
    """
    a, b = np.stack(home["u"].to_numpy()), np.stack(guest["u"].to_numpy())
    h, g = np.nonzero(a @ b.T >= threshold - 1e-9)
    # the last digits by one fixed order of summation, so both sides of a pair agree
    cos = np.concatenate([np.einsum("ij,ij->i", a[h[i : i + 65536]], b[g[i : i + 65536]]) for i in range(0, len(h), 65536)]) if len(h) else np.empty(0)
    good = (cos >= threshold) & (home["id"].to_numpy()[h] != guest["id"].to_numpy()[g])
    return h[good], g[good]


def _spanning(h: np.ndarray, g: np.ndarray, hid: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block the smallest id that links reach inside the block."""
    lh, lg = hid.copy(), gid.copy()
    while len(h):
        nh, ng = lh.copy(), lg.copy()
        np.minimum.at(nh, h, lg[g])
        np.minimum.at(ng, g, nh[h])
        if (nh == lh).all() and (ng == lg).all():
            break
        lh, lg = nh, ng
    src, dst = np.concatenate([hid, gid]), np.concatenate([lh, lg])
    far = src != dst
    return src[far], dst[far]


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.98,
    cell_rows: int = 64,
    most_words: int = 2048,
    block_rows: int = 1024,
    sample_rows: int = 4096,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row for each input row.

    ``n_links``: other rows linked directly; ``component_id``: the smallest id reachable;
    ``kept``: id = component_id. Unusable vectors (null, empty, zero, null or non-finite
    components) link with nothing. Rows with one id and one vector are copies that link like any
    other rows. A row without id links with nothing and has a null component. Vectors of other lengths never link. ``recall``
    holds for one direction of a pair at exactly the threshold; nearer pairs and pairs that visit
    each other have more. ``sample_rows`` bounds what the codebooks are fitted on; every row is indexed.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = src.filter(usable("v") & F.col("id").isNotNull())
    # unit vectors (the largest component first taken out, so squares neither overflow nor vanish)
    top = F.array_max(F.transform("v", F.abs))
    scaled = good.withColumn("v", F.transform("v", lambda x: x / top))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = scaled.select("id", F.transform("v", lambda x: x / norm).alias("u"))
    # equal unit vectors are one row from here on, with the number of rows it stands for
    rows = shared_table(unit.withColumn("vkey", F.sha2(F.to_json(F.col("u")), 256)))
    reps = shared_table(rows.groupBy("vkey").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("u").alias("u")))
    # several ids are no problem, but one id can hold several vectors: points are named by number of the key
    points = reps.withColumn("point", F.xxhash64("vkey")).withColumn("dim", F.size("u"))
    per_dim = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(per_dim.items()):
        one = _links_of(points.filter(F.col("dim") == dim), n, threshold, recall, cell_rows, most_words, block_rows, sample_rows)
        found = one if found is None else found.unionByName(one)
    ids = rows.select("id", "vkey")
    if found is None:
        linked = reps.select("vkey", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    else:
        found = shared_table(found)
        counts = found.filter("links > 0").groupBy("point").agg(F.sum("links").alias("links"))
        comps = connected_components(found.filter("links = 0").select(F.col("point").alias("src"), F.col("other").alias("dst")))
        named = points.select("vkey", "id", "n", "point").join(counts, "point", "left").join(comps, F.col("point") == F.col("node"), "left")
        named = shared_table(
            named.select("vkey", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "point").alias("group"))
        )
        least = shared_table(named.groupBy("group").agg(F.min("id").alias("component")))
        linked = named.join(least, "group").select("vkey", "links", "component")
    linked = shared_table(linked.withColumnRenamed("vkey", "vkey_"))
    with_links = ids.join(linked, F.col("vkey") == F.col("vkey_"), "left")
    with_links = with_links.select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = src.filter(~usable("v") | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = with_links.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links_of(
    points: DataFrame, n: int, threshold: float, recall: float, cell_rows: int, most_words: int, block_rows: int, sample_rows: int
) -> DataFrame:
    """``(point, links, other)``: link counts (``other`` null) and spanning links (``links`` 0) of points of one length."""
    spark = points.sparkSession
    words = max(2, min(most_words, math.ceil(math.sqrt(n / cell_rows))))
    span = 1 << 30
    drawn = points.filter(F.pmod(F.xxhash64("vkey"), F.lit(span)) < F.lit(min(span, span * sample_rows // max(n, 1) + 1)))
    sample = [r.u for r in drawn.select("u").collect()] or [r.u for r in points.select("u").limit(1).collect()]
    grid = spark.sparkContext.broadcast(Grid(np.array(sample, np.float64), words, threshold, recall))

    def place(batches):
        g: Grid = grid.value
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                x = np.stack(part["u"].to_numpy())
                yield pd.DataFrame(
                    {"id": part["point"], "n": part["n"], "u": part["u"], "home": g.cells(x), "visits": [v for v in g.visits(x)]}
                )

    placed = shared_table(
        points.select("point", "n", "u").mapInPandas(place, "id long, n long, u array<double>, home long, visits array<long>")
    )
    # how many blocks a cell's residents and visitors need; at most words^2 cells have a row here
    residents = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block_rows).alias("hb"))
    visits = placed.select("id", "n", "u", "home", F.explode("visits").alias("cell"))
    visitors = visits.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("gb"))
    blocks = shared_table(residents.join(visitors, "cell").select(F.col("cell").alias("cell_"), "hb", "gb"))

    def dealt(rows: DataFrame, mine: str, other: str, role: int) -> DataFrame:
        rows = rows.join(blocks, F.col("cell") == F.col("cell_"))
        own = F.pmod(F.xxhash64("id"), F.col(mine)).alias(mine + "_no")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other + "_no")
        return rows.select(F.lit(role).alias("guest"), "id", "n", "u", "home", "visits", "cell", own, every).select(
            "guest", "id", "n", "u", "home", "visits", "cell", "hb_no", "gb_no"
        )

    none = F.array().cast("array<long>").alias("visits")
    at_home = placed.select("id", "n", "u", "home", "visits", F.col("home").alias("cell"))
    work = dealt(at_home, "hb", "gb", 0).unionByName(dealt(visits.select("id", "n", "u", "home", none, "cell"), "gb", "hb", 1))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = pdf[pdf["guest"] == 0], pdf[pdf["guest"] == 1]
        empty = pd.DataFrame({"point": np.empty(0, np.int64), "links": np.empty(0, np.int64), "other": np.empty(0, np.int64)})
        if not len(home) or not len(guest):
            return empty
        h, g = _block_links(home, guest, threshold)
        if not len(h):
            return empty
        hid, gid = home["id"].to_numpy(np.int64), guest["id"].to_numpy(np.int64)
        # a guest counts its residents; a resident counts the guest here only if it does not visit the guest's cell
        cells, at = np.unique(guest["home"].to_numpy(np.int64), return_inverse=True)
        mutual = np.stack([np.isin(cells, v) for v in home["visits"]])[h, at[g]]
        hn, gn = home["n"].to_numpy(np.float64), guest["n"].to_numpy(np.float64)
        for_guest = np.bincount(g, hn[h], len(guest)).astype(np.int64)
        for_home = np.bincount(h[~mutual], gn[g[~mutual]], len(home)).astype(np.int64)
        counted = pd.DataFrame({"point": np.concatenate([gid, hid]), "links": np.concatenate([for_guest, for_home]), "other": pd.NA})
        src, dst = _spanning(h, g, hid, gid)
        spanning = pd.DataFrame({"point": src, "links": np.int64(0), "other": dst})
        out = pd.concat([counted[counted["links"] > 0], spanning])
        return out.astype({"point": "int64", "links": "int64", "other": "Int64"})

    return work.groupBy("cell", "hb_no", "gb_no").applyInPandas(meet, "point long, links long, other long")
