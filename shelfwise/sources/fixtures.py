"""Logical views over the shared test tables.

``sales_view`` is the bookshop's sales sheet expressed over the TPC-H-like star
schema (one row per order line). ``texts_view`` is the labelled short-text set.
Both are plain joins and projections, so Catalyst prunes columns and pushes
filters down into the parquet scans; the same mapping is written as SQL in
``shelfwise.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of sales lines: (l_orderkey, l_linenumber) alone is not unique.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

SALES_COLUMNS = [
    *LINE_KEY,
    "order_date",
    "customer",
    "book",
    "category",
    "gender",
    "age",
    "delivery",
    "unit",
    "sell_price",
    "buying_price",
    "sell",
    "cost",
    "discount_pct",
    "repeated_customer",
    "review",
    "year",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part ⋈ customer mapped to the sales-sheet columns.

    Join order for scale: orders ⋈ customer first (both far smaller than the
    line items), then the line items meet that on the order key and the parts
    on the part key. When no side is small enough to broadcast, the line-item
    sized data is shuffled twice instead of three times; small dimensions are
    broadcast by the planner and AQE splits a hot part or order key.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    c = table(spark, sf_dir, "customer")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    joined = li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    buying = F.lit(0.7) * F.col("p_retailprice")
    return joined.select(
        *[li[k] for k in LINE_KEY],
        F.col("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer"),
        F.lower(F.trim(F.col("p_name"))).alias("book"),
        F.col("p_type").alias("category"),
        F.col("c_mktsegment").alias("gender"),
        (F.lit(18) + F.col("o_custkey") % 60).cast("double").alias("age"),
        F.col("o_orderpriority").alias("delivery"),
        F.col("l_quantity").alias("unit"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("sell_price"),
        buying.alias("buying_price"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("sell"),
        (buying * F.col("l_quantity")).alias("cost"),
        (F.lit(100) * F.col("l_discount")).alias("discount_pct"),
        F.when(F.col("l_returnflag") == "R", " Yes ")
        .when(F.col("l_returnflag") == "A", "no")
        .otherwise("না")
        .alias("repeated_customer"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).cast("double").alias("review"),
        F.year("o_orderdate").cast("int").alias("year"),
    )


def dirty_sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_view`` plus deterministic dirty columns (FIXTURES.md §4).

    Every row is kept; the modulo expressions only decide which *value* a row
    carries, so the check exercises junk, blanks and nulls over whole tables.
    """
    s = sales_view(spark, sf_dir)
    return s.select(
        "*",
        F.when(F.col("l_linenumber") % 4 == 0, "1.5k")
        .when(F.col("l_linenumber") % 4 == 1, "৳1,200")
        .when(F.col("l_linenumber") % 4 == 2, "")
        .otherwise("n/a")
        .alias("sell_text"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("unit")).alias("unit_missing"),
        F.when(F.col("customer") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("gender")).alias("gender_missing"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit("bad"))
        .otherwise(F.col("order_date").cast("string"))
        .alias("order_date_text"),
        (F.col("sell") * F.when(F.col("l_partkey") % 50 == 0, F.lit(100.0)).otherwise(F.lit(1.0))).alias("sell_outlier"),
    )


def number_text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One human-written number per sales line, in the spellings the sheets use
    (suffixes, currency, commas, blanks, signs, junk), derived from the line.
    Integer arithmetic only, so the SQL oracle can spell the same text."""
    s = sales_view(spark, sf_dir).select(*LINE_KEY, "unit", "sell")
    q = F.col("unit").cast("long").cast("string")
    n = F.floor(F.col("sell")).cast("long")
    thousands = F.floor(n / 1000).cast("long").cast("string")
    rest = F.lpad((n % 1000).cast("string"), 3, "0")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    text = (
        F.when(kind == 0, F.concat(thousands, F.lit("."), rest, F.lit("k")))
        .when(kind == 1, F.concat(F.lit("৳"), thousands, F.lit(","), rest))
        .when(kind == 2, F.concat(q, F.lit(" M")))
        .when(kind == 3, F.concat(F.lit("-"), q))
        .when(kind == 4, F.concat(F.lit("-"), q, F.lit("k")))
        .when(kind == 5, F.concat(F.lit("tk "), q))
        .when(kind == 6, F.lit(""))
        .when(kind == 7, F.lit("abc"))
        .when(kind == 8, F.concat(thousands, F.lit(","), rest, F.lit(" BDT")))
        .when(kind == 9, F.concat(F.lit(" "), q, F.lit("b ")))
        .when(kind == 10, F.lit(None).cast("string"))
        .otherwise(F.concat(q, F.lit(".5")))
    )
    return s.select(*LINE_KEY, text.alias("raw"))


def date_text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text columns per sales line that spell its order date as sheets do: ``ordered`` puts the
    day first (many of its values fit both orders), ``shipped`` the month; both hold spreadsheet
    serial days, named months, ISO dates and junk."""
    s = sales_view(spark, sf_dir).select(*LINE_KEY, "order_date")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    serial = F.datediff("order_date", F.lit("1899-12-30")).cast("string")
    junk = F.array(*map(F.lit, ["n/a", "", "13/13/2024", "2024", "99999", "01/02/3024", "nan"]))

    def spelled(numbers: str):
        return (
            F.when(kind < 4, F.date_format("order_date", numbers))
            .when(kind == 4, F.concat(F.lit(" "), F.date_format("order_date", numbers.replace("/", "-"))))
            .when(kind == 5, F.date_format("order_date", "yyyy-MM-dd"))
            .when(kind == 6, serial)
            .when(kind == 7, F.date_format("order_date", "d-MMM-yyyy"))
            .when(kind == 8, F.element_at(junk, F.col("l_linenumber").cast("int") % 7 + 1))
            .otherwise(F.concat(serial, F.lit(".5")))
        )

    return s.select(*LINE_KEY, spelled("d/M/yyyy").alias("ordered"), spelled("MM/dd/yyyy").alias("shipped"))


def texts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: documents ⋈ labels, ``label = quality``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id")


def all_texts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language as label, for the steps that need no quality label."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
