"""Projections and cleaning.

Statistics that parameterise a step (medians, modes, quantiles, means) are
fitted with one aggregate job each and come back to the driver as a handful of
scalars; the step itself is then a column expression over the whole table. No
cross join and no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.parse import (
    find_repeat_column,
    number_of,
    numeric_date,
    parse_kmb,
    py_strip,
    repeat_flag_expr,
    to_number,
    to_ts,
)
from shelfwise.operators.stats import exact_medians, exact_quantiles, exact_quantiles_by, held_count, mean_std_pop
from shelfwise.session import shared_table

NUMERIC_SALES = ["sell", "cost", "unit", "price", "discount_pct", "sell_price", "buying_price"]
FLAG = "repeated_customer_flag"


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_cols(df: DataFrame) -> list[str]:
    """Numeric columns by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profit_expr(df: DataFrame) -> Column:
    """Sell - cost; else (sell_price - buying_price) with 0 for missing; else NULL."""
    if _has(df, "sell", "cost"):
        return F.col("sell") - F.col("cost")
    if _has(df, "sell_price", "buying_price"):
        return F.coalesce(F.col("sell_price") - F.col("buying_price"), F.lit(0.0))
    return F.lit(None).cast("double")


def with_profit(df: DataFrame, name: str = "profit") -> DataFrame:
    return df.withColumn(name, profit_expr(df))


def clipped_profit_expr(df: DataFrame) -> Column:
    """max((sell price - buying price) * unit, 0), sell/cost standing in for
    the price columns when those are absent; missing values count 0 (unit 1)."""
    sp = F.col("sell_price") if "sell_price" in df.columns else (F.col("sell") if "sell" in df.columns else F.lit(0.0))
    bp = F.col("buying_price") if "buying_price" in df.columns else (F.col("cost") if "cost" in df.columns else F.lit(0.0))
    unit = F.col("unit") if "unit" in df.columns else F.lit(1.0)
    return F.greatest((to_number(sp, 0.0) - to_number(bp, 0.0)) * to_number(unit, 1.0), F.lit(0.0))


def with_repeat_flag(df: DataFrame, bangla: bool = True, name: str = FLAG) -> DataFrame:
    """P5: the yes/no answer column is found by name; missing column -> NULL flag."""
    col = find_repeat_column(df.drop(name) if name in df.columns else df)
    if col is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, repeat_flag_expr(col, bangla))


def date_orders(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """Whether the numeric dates of each text column put the day first.

    One aggregate counts, for every column, the values that each order can read; the order that
    reads more holds for the whole column (month first if both read as many).
    """
    reads = [F.count(numeric_date(f"`{c}`", o)).alias(f"n{i}_{int(o)}") for i, c in enumerate(cols) for o in (False, True)]
    n = df.agg(*reads).first() if cols else None
    return {c: n[f"n{i}_1"] > n[f"n{i}_0"] for i, c in enumerate(cols)}


def with_dates(df: DataFrame, cols: list[str], day_first: bool | None = None) -> DataFrame:
    """Text columns as timestamps, each read in one order of day and month: its own, found by
    :func:`date_orders`, or ``day_first``. A value that only the other order can read is NULL."""
    orders = date_orders(df, cols) if day_first is None else dict.fromkeys(cols, day_first)
    return df.withColumns({c: to_ts(f"`{c}`", orders[c]) for c in cols})


def date_parts(df: DataFrame, date_col: str = "order_date", default_year: int | None = None) -> DataFrame:
    """Year (falling back to an existing year column, then a constant) and month."""
    if date_col not in df.columns:
        return df.withColumn("month", F.lit(None).cast("int"))
    fallback = [F.col("year").cast("int")] if "year" in df.columns else []
    if default_year is not None:
        fallback.append(F.lit(int(default_year)))
    year = F.coalesce(F.year(date_col).cast("int"), *fallback) if fallback else F.year(date_col).cast("int")
    return df.withColumn("year", year).withColumn("month", F.month(date_col).cast("int"))


def fill_unknown(df: DataFrame, cols: list[str] | None = None, value: str = "Unknown") -> DataFrame:
    """String NULLs -> 'Unknown'."""
    return df.na.fill(value, subset=cols or _string_cols(df))


def fill_zero(df: DataFrame) -> DataFrame:
    """P10: every NULL -> 0 (strings get '0')."""
    return df.na.fill(0).na.fill("0")


def fill_median(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Numeric NULLs -> the column's exact median, which need not be whole: the columns become doubles."""
    cols = cols or numeric_cols(df)
    med = exact_medians(df, cols)
    out = df
    for c in cols:
        if med[c] is not None:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))))
    return out, med


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value of each column; ties -> the smallest value (pandas
    ``mode()[0]``). One scan: (column, value) pairs are counted with partial
    aggregation and each column keeps its best pair."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("b"))
    return {cols[r["i"]]: r["b"]["v"] for r in best.collect()}


def column_mode(df: DataFrame, col: str) -> object | None:
    """The mode of one text column."""
    return column_modes(df, [col]).get(col)


def fill_mode(df: DataFrame, cols: list[str] | None = None, default: str = "unknown") -> tuple[DataFrame, dict]:
    """NULLs of text columns -> the column's mode, ``default`` when it has none."""
    cols = cols or _string_cols(df)
    found = column_modes(df, cols) if cols else {}
    modes = {c: found.get(c, default) for c in cols}
    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(modes[c])))
    return out, modes


def standardize_category(col: Column | str, allowed: list[str], other: str = "unknown") -> Column:
    """Lower-cased value if it is one of ``allowed``, else ``other``."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.lower(py_strip(c.cast("string")))
    return F.when(s.isin(*allowed), s).otherwise(F.lit(other))


def high_value_flag(df: DataFrame, col: str = "profit", q: float = 0.8, name: str = "high_value_customer") -> tuple[DataFrame, float]:
    """1 when ``col`` >= its q-quantile."""
    thr = exact_quantiles(df, col, [q])[0]
    flag = F.when(F.col(col) >= F.lit(thr), 1).otherwise(0) if thr is not None else F.lit(0)
    return df.withColumn(name, flag.cast("int")), thr


def iqr_filter(df: DataFrame, cols: list[str], k: float = 1.5) -> tuple[DataFrame, list[dict]]:
    """Sequential IQR outlier removal. Each column's bounds come from the rows
    left by the previous column.

    Bounds are fitted on the listed columns alone, kept in memory (or spilled) for
    the fit and released after it; the input itself is never copied: the result is
    the input with the filters on it.
    """
    cols = [c for c in cols if c in df.columns]
    report, kept = [], F.lit(True)
    slim = df.select(*[F.col(f"`{c}`") for c in cols]).persist()

    def counted(i: int) -> tuple[int, int]:
        """Rows left, and values of the next column in them: one job for both."""
        held = held_count(cols[i]) if i < len(cols) else F.count(F.lit(1))
        r = slim.where(kept).agg(F.count(F.lit(1)).alias("rows"), held.alias("held")).first()
        return r["rows"], r["held"]

    try:
        left, held = counted(0)
        for i, c in enumerate(cols):
            q1, q3 = exact_quantiles_by(slim.where(kept), {c: [0.25, 0.75]}, {c: held})[c]
            lower = upper = None
            if q1 is None:
                kept = F.lit(False)
            else:
                lower, upper = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
                kept = kept & (F.col(f"`{c}`") >= F.lit(lower)) & (F.col(f"`{c}`") <= F.lit(upper))
            after, held = counted(i + 1)
            report.append({"column": c, "lower": lower, "upper": upper, "removed": left - after})
            left = after
    finally:
        slim.unpersist()
    return df.where(kept), report


def label_encode(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """code = rank of the value among the column's sorted distinct values
    (0-based); NULL stays NULL.

    The levels of all columns come from one scan (one partially aggregated distinct),
    are ranked together by the distributed index and joined back per column; the
    planner broadcasts a level table whose size it knows to be small.
    """
    from shelfwise.operators.rank import rank_within

    pairs = F.array(*[F.struct(F.lit(i).alias("_col"), F.col(f"`{c}`").cast("string").alias("_lvl")) for i, c in enumerate(cols)])
    levels = df.select(F.inline(pairs)).where(F.col("_lvl").isNotNull()).distinct()
    ranked = shared_table(rank_within(levels, ["_col"], ["_lvl"], name="_code"))
    out = df
    for i, c in enumerate(cols):
        codes = ranked.where(F.col("_col") == i).select(F.col("_lvl").alias("_lvl_"), (F.col("_code") - 1).cast("int").alias("_code_"))
        joined = out.join(codes, F.col(f"`{c}`").cast("string") == F.col("_lvl_"), "left")
        out = joined.withColumn(c + suffix, F.col("_code_")).drop("_lvl_", "_code_")
    return out


def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Z-score with population std (std 0 -> divide by 1)."""
    stats = mean_std_pop(df, cols)
    out = df
    for c in cols:
        m, s = stats[c]
        s = s if s else 1.0
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s))
    return out, stats


def unstandardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    out = df
    for c, (m, s) in stats.items():
        s = s if s else 1.0
        out = out.withColumn(c + suffix, F.col(c) * F.lit(s) + F.lit(m))
    return out


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def total_amount(df: DataFrame, qty: str = "unit", price: str = "sell_price", name: str = "total_amount") -> DataFrame:
    """total = quantity * price when there is no total column."""
    if name in df.columns or not _has(df, qty, price):
        return df
    return df.withColumn(name, F.col(qty) * F.col(price))


def null_summary(df: DataFrame) -> DataFrame:
    """P20: per column its type, NULL count and the row count, in one scan."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(
        f"'{c.replace(chr(39), chr(39) * 2)}', '{df.schema[c].dataType.simpleString()}', _n{i}"
        for i, c in enumerate(df.columns)
    )
    return wide.selectExpr(
        f"stack({len(df.columns)}, {pairs}) as (column_name, data_type, null_count)", "_rows as row_count"
    )


def non_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values that do not read as numbers, per column.
    One scan for all columns: (column, value) pairs are exploded per row, and
    one partially aggregated distinct follows."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull() & number_of("value").isNull())
        .distinct()
    )


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 column per level (sorted), the first level dropped; the source
    column is replaced. The levels of all columns come from one scan; each becomes a
    column, so what comes to the driver is the result's own header."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    found = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct().collect()
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in found:
        levels[r["c"]].append(r["v"])
    out = df
    for c in cols:
        vals = sorted(levels[c])
        keep = vals[1:] if drop_first else vals
        src = F.col(c).cast("string")
        out = out.select("*", *[(src == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in keep]).drop(c)
    return out


def prepare_sales(df: DataFrame, default_year: int | None = None, day_first: bool | None = None) -> DataFrame:
    """The dashboard's load step on a raw sales sheet: coerce the date and the
    number columns, profit, repeated-customer flag, age, year/month, and fill
    string NULLs with 'Unknown'. A text date column is read in the order of day and month that
    one pass over it finds, or in ``day_first`` (a stream, which cannot be looked over first, needs it)."""
    out = df
    if "order_date" in out.columns and not isinstance(out.schema["order_date"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = with_dates(out, ["order_date"], bool(day_first) if out.isStreaming else day_first)
    for c in NUMERIC_SALES:
        if c in out.columns:
            out = out.withColumn(c, parse_kmb(c, out))
    out = with_profit(out)
    out = with_repeat_flag(out)
    if "age" in out.columns:
        out = out.withColumn("age", to_number("age"))
    out = date_parts(out, default_year=default_year)
    return fill_unknown(out)


def numeric_safe(df: DataFrame) -> DataFrame:
    """The dashboard's post-filter coercion: sell/profit NULL -> 0, unit NULL -> 1."""
    sell = F.col("sell") if "sell" in df.columns else (F.col("sell_price") if "sell_price" in df.columns else F.lit(0.0))
    out = df.withColumn("sell", to_number(sell, 0.0))
    out = out.withColumn("profit", to_number(F.col("profit") if "profit" in out.columns else F.lit(0.0), 0.0))
    out = out.withColumn("unit", to_number(F.col("unit") if "unit" in out.columns else F.lit(1.0), 1.0))
    if "age" in out.columns:
        out = out.withColumn("age", to_number("age"))
    return out
