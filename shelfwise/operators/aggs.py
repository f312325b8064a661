"""Aggregations, rankings and distributions.

All of them are hash aggregates with a map-side partial step; windows only run
over the (small) aggregated result, never over raw rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import shared_table

from shelfwise.operators.clean import FLAG, clipped_profit_expr

MONTHS = list(range(1, 13))


def _flag() -> F.Column:
    return F.col(FLAG)


def kpis(orders: DataFrame) -> DataFrame:
    """G1: KPIs on de-duplicated orders: sum of sell x unit, clipped profit,
    orders, distinct books, repeat %."""
    return orders.agg(
        F.sum(F.coalesce(F.col("sell"), F.lit(0.0)) * F.col("unit")).alias("total_sell"),
        F.sum(clipped_profit_expr(orders)).alias("total_profit"),
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("book").alias("unique_books"),
        (F.avg(_flag()) * 100).alias("repeat_pct"),
    )


def kpis_raw(df: DataFrame) -> DataFrame:
    """KPIs on raw rows: sum of sell and profit, rows, distinct books, repeat %."""
    return df.agg(
        F.coalesce(F.sum("sell"), F.lit(0.0)).alias("total_sell"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("total_profit"),
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("book").alias("unique_books"),
        (F.avg(_flag()) * 100).alias("repeat_pct"),
    )


def customer_counts(df: DataFrame) -> DataFrame:
    """Total sales, customers (rows), repeated, new = total - repeated."""
    return df.agg(
        F.coalesce(F.sum("sell"), F.lit(0.0)).alias("total_sales"),
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum(_flag()), F.lit(0)).cast("long").alias("repeated_customers"),
    ).withColumn("new_customers", F.col("total_customers") - F.col("repeated_customers"))


def sum_by(df: DataFrame, dim: str, measure: str, name: str | None = None) -> DataFrame:
    """Sum of a measure per dimension value, largest first (NULL keys dropped)."""
    name = name or f"total_{measure}"
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(name))
        .orderBy(F.col(name).desc(), F.col(dim))
    )


def top_n(df: DataFrame, key: str, measure: str, n: int = 10, name: str | None = None) -> DataFrame:
    """Top-n keys by summed measure (ties by key). Bounded top-k, no full sort."""
    name = name or f"total_{measure}"
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(name))
    return agg.orderBy(F.col(name).desc(), F.col(key)).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, largest first, with its share in percent."""
    kept = df.where(F.col(col).isNotNull())
    counts = shared_table(kept.groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0] or 1  # from the counts: the input is read once
    share = F.col("count") * 100.0 / F.lit(total)
    return counts.withColumn("share_pct", share).orderBy(F.col("count").desc(), F.col(col))


def retention_by(df: DataFrame, dim: str) -> DataFrame:
    """Mean repeated flag x 100 per dimension value."""
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(dim)
        .agg((F.avg(_flag()) * 100).alias("repeated_pct"))
        .orderBy(dim)
    )


def repeat_by_year(df: DataFrame) -> DataFrame:
    """Repeated customers per year."""
    return (
        df.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.coalesce(F.sum(_flag()), F.lit(0)).cast("long").alias("repeated_customers"))
        .orderBy("year")
    )


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bins`` equal-width bins between min and max; empty bins kept, the
    maximum falls in the last bin. One-row bounds, then one aggregate."""
    b = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        )
        .orderBy("bin")
    )


def rating_distribution(df: DataFrame, col: str = "review") -> DataFrame:
    """Count per rating and its percent of all ratings, 2 decimals."""
    r = df.select(F.col(col).try_cast("double").alias("rating")).where(F.col("rating").isNotNull())
    counts = shared_table(r.groupBy("rating").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0] or 1
    pct = F.round(F.col("count") * 100.0 / F.lit(total), 2)
    return counts.withColumn("percent", pct).orderBy("rating")


def rfm(df: DataFrame, as_of: _dt.date | _dt.datetime | None = None, n: int | None = 20,
        customer: str = "customer", date_col: str = "order_date") -> DataFrame:
    """Per customer: frequency, monetary, last order, recency in days against
    ``as_of`` (default: the latest order date, never the wall clock); top ``n``
    by monetary (``n=None`` keeps every customer)."""
    per = df.groupBy(customer).agg(
        F.count(date_col).alias("frequency"),
        F.coalesce(F.sum("sell"), F.lit(0.0)).alias("monetary"),
        F.max(date_col).alias("last_order"),
    )
    if as_of is None:
        per = shared_table(per)
        as_of = per.agg(F.max("last_order")).first()[0]  # from the customers' last orders: the input is read once
    per = per.where(F.col(customer).isNotNull()).withColumn(
        "recency_days", F.datediff(F.lit(as_of).cast("date"), F.col("last_order").cast("date")))
    ranked = per.orderBy(F.col("monetary").desc(), F.col(customer))
    return ranked.limit(n) if n else ranked


def season(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Sum of sell per (year, month number)."""
    return (
        df.select("year", F.month(date_col).alias("month"), "sell")
        .where(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy("year", "month")
        .agg(F.coalesce(F.sum("sell"), F.lit(0.0)).alias("total_sell"))
        .orderBy("year", "month")
    )


def year_month_pivot(df: DataFrame, date_col: str = "order_date", measure: str = "sell") -> DataFrame:
    """Year x month table of summed sell, empty cells 0 (``m1`` .. ``m12``).
    The month list is fixed, so the pivot needs no extra distinct job."""
    base = df.select(F.year(date_col).cast("int").alias("year"), F.month(date_col).alias("month"), measure).where(
        F.col("year").isNotNull()
    )
    wide = base.groupBy("year").pivot("month", MONTHS).agg(F.sum(measure))
    return wide.select("year", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m}") for m in MONTHS]).orderBy("year")


def month_of_year(df: DataFrame, date_col: str = "order_date", measure: str = "sell") -> DataFrame:
    """Summed measure per month of year, all 12 months present."""
    sums = (
        df.select(F.month(date_col).alias("month"), measure)
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.sum(measure).alias("total"))
    )
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (
        months.join(F.broadcast(sums), "month", "left")
        .select("month", F.coalesce(F.col("total"), F.lit(0.0)).alias(f"total_{measure}"))
        .orderBy("month")
    )
