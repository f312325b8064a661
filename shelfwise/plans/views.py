"""The prepared sales views every dashboard query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.clean import numeric_safe, prepare_sales
from shelfwise.operators.filters import dashboard_defaults, dedup_orders
from shelfwise.sources.fixtures import LINE_KEY, sales_view


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's load step over the sales view."""
    return prepare_sales(sales_view(spark, sf_dir))


def select_then_prepare(raw: DataFrame, **lists) -> DataFrame:
    """F1 with pushdown: an IN-list without 'Unknown' selects the same rows
    before and after the 'Unknown' fill (filling only changes NULLs), so it is
    applied to the raw column, where the scan can use it. The year is that of the
    order date, whatever the sheet's own year says, so a year list is tested after
    preparing; before it only becomes order-date ranges (row-group pruning). The rest
    (``ALL``, lists naming 'Unknown') is applied after preparing, as before."""
    from shelfwise.operators.filters import ALL, apply_filters

    early = {c: v for c, v in lists.items()
             if c != "year" and v is not None and v is not ALL and "Unknown" not in list(v) and c in raw.columns}
    pre = raw
    years, date = lists.get("year"), dict(raw.dtypes).get("order_date", "")
    if years is not None and years is not ALL and len(years) > 0 and (date == "date" or date.startswith("timestamp")):
        ranges = F.col("order_date").isNull()  # a missing date may still get its year from the file
        for y in sorted(set(int(v) for v in years)):
            ranges = ranges | ((F.col("order_date") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (
                F.col("order_date") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz")))
        pre = pre.where(ranges)
    return apply_filters(prepare_sales(apply_filters(pre, **early)), **lists)


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default dashboard selection (all non-null options) + numeric coercion."""
    return numeric_safe(dashboard_defaults(prepared(spark, sf_dir)))


def unique_orders(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """F4 over the filtered set: one row per (date, customer, book); ``columns``
    narrows the rows carried through the de-duplication."""
    return dedup_orders(filtered(spark, sf_dir), LINE_KEY, columns=columns)


def rounded(df: DataFrame, digits: int = 2, cols: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (for stable comparison with the SQL oracle)."""
    cols = cols or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`"), cols.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
