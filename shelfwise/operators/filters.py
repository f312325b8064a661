"""Filters, de-duplication and the book join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.parse import norm_key
from shelfwise.session import shared_table
from shelfwise.sources.io import ROW_KEY


class _All:
    """Sentinel: every non-null option (the dashboard's pre-selected default)."""

    def __repr__(self) -> str:
        return "ALL"


ALL = _All()
DASHBOARD_DIMS = ["year", "category", "gender", "delivery"]


def apply_filters(df: DataFrame, **lists) -> DataFrame:
    """AND of optional IN-lists. ``None`` or an empty list = no filter;
    ``ALL`` = all options, which drops rows whose value is NULL."""
    out = df
    for col, values in lists.items():
        if col not in out.columns or values is None:
            continue
        if values is ALL:
            out = out.where(F.col(col).isNotNull())
        elif len(values) > 0:
            out = out.where(F.col(col).isin(list(values)))
    return out


def dashboard_defaults(df: DataFrame) -> DataFrame:
    """F1 with the dashboard's default selection on all four dimensions."""
    return apply_filters(df, **{d: ALL for d in DASHBOARD_DIMS})


def filter_options(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """sorted distinct non-null options per dimension, as (dimension, value).
    One scan and one (partially aggregated) shuffle for all dimensions."""
    dims = [d for d in (dims or DASHBOARD_DIMS) if d in df.columns]
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dimension", "value")
    )


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """drop rows with a NULL in any (or any listed) column."""
    return df.na.drop(how="any", subset=subset)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """F4 core: keep the first row per key by ``order`` (NULL key parts match);
    the remaining columns break ties, so the result is the same on every run.

    ``row_number() = 1`` over the key lets Catalyst plan a partial
    ``WindowGroupLimit`` before the exchange: every map task keeps only its
    first row per key, so a key holding a third of all rows is cut down on
    each executor before anything is shuffled.
    """
    from pyspark.sql import Window

    rest = [c for c in df.columns if c not in keys and c not in order]
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{c}`") for c in [*order, *rest]])
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


ORDER_KEYS = ["order_date", "customer", "book"]


def dedup_orders(df: DataFrame, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """one row per (order date, customer, book), the first line kept.

    ``order`` says what first means (default: the files' own order, if the reader
    kept it); the remaining columns break ties.

    ``columns``: the only other columns the caller needs. They are projected
    before the de-duplication (in the frame's own column order, so the
    tie-break order is kept), and the shuffle and sort carry only them.
    """
    if order is None:
        order = [c for c in ROW_KEY if c in df.columns]
    if columns is not None:
        keep = set(ORDER_KEYS) | set(order) | set(columns)
        df = df.select(*[c for c in df.columns if c in keep])
    return dedup_first(df, ORDER_KEYS, order)


def distinct_rows(df: DataFrame) -> DataFrame:
    """drop fully equal rows."""
    return df.distinct()


def join_books(sales: DataFrame, books: DataFrame, key: str = "book", book_order: list[str] | None = None) -> DataFrame:
    """Left join of sales to the book list on the normalised name; the book
    list is de-duplicated first (first row per name) and clashing attribute
    columns get a ``book_`` prefix instead of pandas' ``_x``/``_y``. The reduced
    list is written once, so the planner knows its bytes and broadcasts it only
    under its own threshold."""
    b = books.withColumn(key, norm_key(key))
    b = dedup_first(b, [key], book_order or [c for c in b.columns if c != key][:1])
    clash = [c for c in b.columns if c != key and c in sales.columns]
    for c in clash:
        b = b.withColumnRenamed(c, f"book_{c}")
    s = sales.withColumn(key, norm_key(key))
    return s.join(shared_table(b), key, "left")
