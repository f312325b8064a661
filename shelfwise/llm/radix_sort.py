"""Distributed least-significant-digit radix sort over integer keys.

The keys become one bit string, most significant key first, which is cut into digits. Every pass,
from the last digit to the first, is a stable counting sort of the whole table: each block of
rows counts its digits; global prefix offsets (digits before digits, then blocks before blocks)
tell where a block's rows of a digit go; the rows of a block, in their order, take the places from
there on. Places are dealt into blocks of ``block_rows`` again, so a pass moves every row once and
no block grows, however often a key repeats. After the last pass a row's place is its rank.

What is gathered is bounded: the bounds of the keys on the driver, ``2 ** digit_bits`` totals in one
task, one block in a group. Each pass is written to the shared folder, so a lost executor
costs tasks of one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import shared_table

_LOWEST = -(1 << 63)


def _bits(df: DataFrame, keys: list[tuple[str, bool]]) -> tuple[list[tuple[Column, int]], int]:
    """For each key a column of whole numbers from 0, in sorting order, and its bits; and the row count."""
    asked = [f(F.col(k).cast("long")).alias(f"{name}{i}") for i, (k, _) in enumerate(keys) for name, f in (("least", F.min), ("most", F.max), ("held", F.count))]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *asked).first()
    out = []
    for i, (k, ascending) in enumerate(keys):
        least, most = seen[f"least{i}"] or 0, seen[f"most{i}"] or 0
        c, span, gaps = F.col(k).cast("long"), most - least, seen[f"held{i}"] < seen["rows"]
        if span < (1 << 62):
            value = c - F.lit(least) if ascending else F.lit(most) - c
            out.append((F.coalesce(value, F.lit(span + 1)), (span + gaps).bit_length()))
        else:
            # the sign bit turned round: unsigned order; the key's nulls are a digit of their own before it
            value = c.bitwiseXOR(F.lit(_LOWEST))
            out.append((c.isNull().cast("long"), int(gaps)))
            out.append((F.coalesce(value if ascending else F.bitwise_not(value), F.lit(0)), 64))
    return out, seen["rows"]


def digits_of(keys: list[tuple[Column, int]], digit_bits: int) -> list[Column]:
    """Digit columns of the composed keys, least significant first."""
    composed: list[tuple[Column, int]] = []
    for value, bits in reversed(keys):
        if not bits:
            continue
        if composed and composed[-1][1] + bits <= 62:
            low, below = composed.pop()
            composed.append((F.shiftleft(value, below).bitwiseOR(low), below + bits))
        else:
            composed.append((value, bits))
    out = []
    for value, bits in composed:
        passes = -(-bits // digit_bits)
        width = -(-bits // passes)
        out += [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(passes)]
    return out


def _pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One stable counting sort by ``digit``; rows carry ``block_`` and ``at_``, their order in the block."""
    kept = rows.columns
    rows = rows.withColumn("digit_", digit)
    counts = rows.groupBy("block_", "digit_").count()
    before = Window.partitionBy("digit_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    digits_before = Window.orderBy("digit_").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("digit_").agg(F.sum("count").alias("n")).select("digit_", F.coalesce(F.sum("n").over(digits_before), F.lit(0)).alias("base"))
    starts = counts.select("block_", "digit_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    starts = starts.join(base, "digit_").select("block_", "digit_", (F.col("base") + F.col("before")).alias("start"))
    starts = starts.toDF("of_block_", "of_digit_", "start")  # names of its own: both sides come from the same rows

    def place(mine: pa.Table, offsets: pa.Table) -> pa.Table:
        mine = mine.take(pa.array(np.argsort(mine["at_"].to_numpy(), kind="stable")))
        digit = mine["digit_"].to_numpy()
        order = np.argsort(digit, kind="stable")
        known, first, size = np.unique(digit[order], return_index=True, return_counts=True)
        start = dict(zip(offsets["of_digit_"].to_pylist(), offsets["start"].to_pylist()))
        goes = np.empty(len(digit), np.int64)
        goes[order] = np.arange(len(digit)) - np.repeat(first, size) + np.repeat([start[d] for d in known.tolist()], size)
        new = {"block_": goes // block_rows, "at_": goes}
        return pa.table([pa.array(new[c], pa.int64()) if c in new else mine[c] for c in kept], names=kept)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.groupBy("block_").cogroup(starts.groupBy("of_block_")).applyInArrow(place, fields)


def ranked(df: DataFrame, keys: list[tuple[str, bool]], out_col: str = "rank", digit_bits: int = 12, block_rows: int = 200_000) -> DataFrame:
    """``df`` with ``out_col``: 1, 2, 3, ... in the order of ``keys``, pairs of an integer column and "ascending".

    Nulls come after all numbers, rows of equal keys in some order, each with a rank of its own.
    All columns travel in every pass: keep them few. A clash with ``out_col``, ``block_``, ``at_`` or ``digit_`` is an error.
    """
    clash = {out_col, "block_", "at_", "digit_"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already: {sorted(clash)}")
    number = F.monotonically_increasing_id()  # partition and place in it; fixed by the table that is written
    rows = shared_table(df.withColumn("at_", number)).withColumn("block_", F.shiftright("at_", 33))
    bits, n = _bits(rows, keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, min(block_rows, -(-n // max(tasks, 1))))
    for digit in digits_of(bits, digit_bits):
        rows = shared_table(_pass(rows, digit, block))
    if not digits_of(bits, digit_bits):  # all keys equal: any order will do, but it must be dense
        rows = shared_table(_pass(rows, F.lit(0), block))
    return rows.withColumn(out_col, F.col("at_") + 1).drop("at_", "block_")
