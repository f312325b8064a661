"""Exact, scalable column statistics used by the fitting steps.

pandas ``quantile`` interpolates linearly between order statistics. Spark's
``percentile`` does the same, but its final merge holds every distinct value
in one task. Here an order statistic is closed in on by counting alone:

1. one aggregate gives each column's count;
2. in rounds, a coarse ``percentile_approx`` sketch of the rows still inside a
   bracket proposes split points, and one aggregate counts the rows below and up
   to each of them, which is exact; a split point is the value sought (however
   often it ties) or the bracket's new end;
3. brackets of few rows are read off as (value, count) pairs.

Every round serves all columns and ranks together, so the number of jobs does not
grow with them; nothing but counts and the last few thousand distinct values
leaves the executors, at any size and with any ties.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one bracket that are read off instead of narrowed further.
READ_OFF = 5_000
#: Sketch accuracy of a round (small, since the counts decide) and the reach of its split points.
ACCURACY = 2_000
REACH = (0.05, 0.002)


@dataclass
class _Target:
    """One 0-based rank of a column and the open bracket that holds it (None: no end yet)."""

    col: str
    rank: int
    inside: int
    lo: object = None
    hi: object = None
    below: int = 0  # rows up to and with ``lo``
    found: tuple | None = None  # (value, rows below it, rows equal to it)

    def bracket(self) -> tuple:
        return self.col, self.lo, self.hi

    def holds(self):
        x = F.col(self.col)
        held = x.isNotNull()
        if self.lo is not None:
            held = held & (x > F.lit(self.lo))
        return held if self.hi is None else held & (x < F.lit(self.hi))


def _place(x: Column, splits: list, first: int = 0) -> Column:
    """Where a value lies among ascending split points: ``2 i`` below the i-th, ``2 i + 1`` on it; a few comparisons a value."""
    if not splits:
        return F.lit(2 * first)
    m = len(splits) // 2
    at = F.lit(splits[m])
    return (F.when(x < at, _place(x, splits[:m], first)).when(x == at, F.lit(2 * (first + m) + 1))
            .otherwise(_place(x, splits[m + 1:], first + m + 1)))


def _counts(vals: DataFrame, splits: dict[str, list]) -> dict[str, dict]:
    """For each split point of each column the rows below it and up to it: one grouped count, whatever their number."""
    cols = list(splits)
    places = [F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull(), _place(F.col(c), splits[c])).alias("p")) for i, c in enumerate(cols)]
    rows = vals.select(F.inline(F.array(*places))).where("p is not null").groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"))
    n = {(r["c"], r["p"]): r["n"] for r in rows.collect()}  # two rows a split point
    out: dict[str, dict] = {}
    for i, c in enumerate(cols):
        out[c], seen = {}, 0
        for j, s in enumerate(splits[c]):
            under = seen + n.get((i, 2 * j), 0)
            seen = under + n.get((i, 2 * j + 1), 0)
            out[c][s] = (under, seen)
    return out


def _narrow(vals: DataFrame, todo: list[_Target]) -> None:
    """One round: propose split points, count around them, shrink every bracket.

    A split point is a value inside the bracket, so each either is the rank's value or
    becomes an end that leaves its own rows out: a round always gains.
    """
    brackets: dict[tuple, _Target] = {}
    probs: dict[tuple, set[float]] = {}
    for t in todo:  # targets of one bracket share its sketch
        p = (t.rank - t.below + 0.5) / t.inside
        brackets.setdefault(t.bracket(), t)
        probs.setdefault(t.bracket(), {p}).update({p} | {min(max(p + d, 0.0), 1.0) for r in REACH for d in (-r, r)})
    sketches = [F.percentile_approx(F.when(t.holds(), F.col(t.col)), sorted(probs[b]), ACCURACY).alias(f"s{i}")
                for i, (b, t) in enumerate(brackets.items())]
    proposed = vals.agg(*sketches).first()
    own = {b: sorted(set(proposed[f"s{i}"])) for i, b in enumerate(brackets)}
    counted = _counts(vals, {c: sorted({s for b, t in brackets.items() if t.col == c for s in own[b]}) for c in {t.col for t in todo}})
    for t in todo:
        end = t.below + t.inside
        for s in own[t.bracket()]:
            under, upto = counted[t.col][s]
            if t.rank < under:
                t.hi, end = s, under
                break
            if t.rank < upto:
                t.found = (s, under, upto - under)
                break
            t.lo, t.below = s, upto
        t.inside = end - t.below


def _settle(vals: DataFrame, targets: list[_Target]) -> list[tuple]:
    """For each target: (value, rows below it, rows equal to it)."""
    while todo := [t for t in targets if t.found is None and t.inside > READ_OFF]:
        _narrow(vals, todo)
    read = [(i, t) for i, t in enumerate(targets) if t.found is None]
    for kind in {vals.schema[t.col].dataType.simpleString() for _, t in read}:  # one job for each value type
        mine = [(i, t) for i, t in read if vals.schema[t.col].dataType.simpleString() == kind]
        same = [F.when(t.holds(), F.struct(F.lit(i).alias("t"), F.col(t.col).alias("x"))) for i, t in mine]
        rows = vals.where(reduce(or_, [t.holds() for _, t in mine])).select(F.explode(F.filter(F.array(*same), lambda s: s.isNotNull())).alias("s"))
        pairs = rows.groupBy("s.t", "s.x").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(pairs, key=lambda r: (r["t"], r["x"])):
            t = targets[r["t"]]
            if t.found is None and t.rank < t.below + r["n"]:
                t.found = (r["x"], t.below, r["n"])
            t.below += r["n"]
    return [t.found for t in targets]


def _sizes(vals: DataFrame) -> dict[str, int]:
    """Non-null count of every column, one aggregate."""
    row = vals.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(vals.columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(vals.columns)}


def _as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    return df.select(*[F.when(~F.isnan(v), v).alias(f"x{i}") for i, v in enumerate(x)])


def held_count(col: str):
    """How many values of a column the quantiles are of (NULL and NaN left out), as an aggregate."""
    x = F.col(f"`{col}`").cast("double")
    return F.count(F.when(~F.isnan(x), x))


def exact_quantiles_by(df: DataFrame, wanted: dict[str, list[float]], sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns (NULL and NaN ignored); None for an empty column.
    ``sizes``: the columns' :func:`held_count`, where a caller has them already."""
    cols = list(wanted)
    if not cols:
        return {}
    vals = _as_double(df, cols)
    known = {f"x{i}": sizes[c] for i, c in enumerate(cols)} if sizes else _sizes(vals)
    targets, where = [], []
    for i, c in enumerate(cols):
        n = known[f"x{i}"]
        for j, q in enumerate(wanted[c]):
            if n:
                pos = (n - 1) * q
                targets += [_Target(f"x{i}", math.floor(pos), n), _Target(f"x{i}", math.ceil(pos), n)]
                where.append((c, j, pos - math.floor(pos)))
    got = _settle(vals, targets)
    out: dict[str, list] = {c: [None] * len(wanted[c]) for c in cols}
    for k, (c, j, part) in enumerate(where):
        low, high = got[2 * k][0], got[2 * k + 1][0]
        out[c][j] = low + (high - low) * part if part else low
    return out


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles of ``col`` (NULL and NaN ignored)."""
    return exact_quantiles_by(df, {col: list(qs)})[col]


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns, all closed in on together."""
    return {c: v[0] for c, v in exact_quantiles_by(df, {c: [0.5] for c in cols}).items()}


def mean_std_pop(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def order_statistics(df: DataFrame, col: str, ranks: list[int], with_counts: bool = False) -> list:
    """Exact values at 0-based ``ranks`` of the non-null ``col`` in ascending order, in the column's
    own integer or floating type (64-bit keys stay exact). ``with_counts``: (value, rows below
    the value, rows equal to it)."""
    vals = df.select(F.col(col).alias("x"))
    if not isinstance(vals.schema["x"].dataType, (T.IntegralType, T.FractionalType)):
        raise TypeError(f"{col}: order statistics need a numeric column")
    n = _sizes(vals)["x"]
    got = _settle(vals, [_Target("x", r, n) for r in ranks if r < n])
    found = [g if with_counts else g[0] for g in got]
    return found + [None] * (len(ranks) - len(found))
