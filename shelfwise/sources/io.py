"""Readers and writers."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".txt": "csv"}
YEAR_IN_NAME = r"(20\d{2})"


def _format_for(path: str) -> str:
    low = path.lower().rstrip("/")
    for ext, fmt in _FORMATS.items():
        if low.endswith(ext):
            return fmt
    return "csv"


def read_table(spark: SparkSession, path: str | list[str], fmt: str | None = None, schema=None,
               base_path: str | None = None, multiline: bool = False) -> DataFrame:
    """S3: reader chosen by extension; anything unknown is read as CSV with a header.

    CSV fields follow the usual dialect (quotes doubled inside quotes). ``multiline`` also
    allows line breaks inside quotes; it makes a file one task's work, so it is off unless asked for.
    """
    first = path[0] if isinstance(path, list) else path
    fmt = fmt or _format_for(first)
    reader = spark.read.format(fmt)
    if base_path:  # keep partition columns (year=...) when reading through a glob
        reader = reader.option("basePath", base_path)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", False)
    if fmt in ("parquet", "orc") and schema is None:
        reader = reader.option("mergeSchema", True)
    return reader.load(path)


# The sheets' headers and the logical names of the columns.
HEADERS = {
    "order date": "order_date",
    "customer phone": "customer",
    "name of books": "book",
    "category of books": "category",
    "gender": "gender",
    "age": "age",
    "delivery method": "delivery",
    "unit": "unit",
    "price": "price",
    "discount %": "discount_pct",
    "sell": "sell",
    "cost": "cost",
    "sell price": "sell_price",
    "buying price": "buying_price",
    "repeated customer?": "repeated_customer",
    "review(out of 5)": "review",
    "year": "year",
}


def logical_names(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """A sheet's headers (blanks and case aside) translated to the logical column names; others stay,
    trimmed. A header is left alone where its logical name is a column already."""
    headers = headers or HEADERS
    have = {c.strip() for c in df.columns}
    names = []
    for c in df.columns:
        to = headers.get(" ".join(c.split()).lower())
        names.append(to if to and (to not in have or c.strip() == to) and to not in names else c.strip())
    return df.toDF(*names)


#: Columns that say where a row stood: file, block of the file, place in it. Their order is the files' order.
ROW_KEY = ["row_file", "row_block", "row_no"]


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``ROW_KEY`` to rows just read from files."""
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("row_file"),
        F.col("_metadata.file_block_start").alias("row_block"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _file_year(path: str, pattern: str = YEAR_IN_NAME) -> Column:
    """Year written in the given file or folder name (not in part-file names)."""
    m = re.search(pattern, os.path.basename(path.rstrip("/")))
    return F.lit(int(m.group(1)) if m else None).cast("int")


def read_yearly(spark: SparkSession, paths: list[str], fmt: str | None = None, year_col: str = "year",
                year_pattern: str = YEAR_IN_NAME, multiline: bool = False, row_key: bool = False) -> DataFrame:
    """Read yearly sales files and union them by column name.

    A file's own year column (in any case) is kept, and a missing value in it falls back to
    the year in the file name; without one the file name gives the column. ``row_key`` adds
    ``ROW_KEY``, the files' own order.
    """
    frames = []
    for p in paths:  # a handful of yearly files: the loop is over files, not rows
        df = read_table(spark, p, fmt, multiline=multiline)
        if row_key:
            df = with_row_key(df)
        own = next((c for c in df.columns if c.strip().lower() == year_col.lower()), None)
        fy = _file_year(p, year_pattern)
        if own is None:
            df = df.withColumn(year_col, fy)
        else:
            kept = F.coalesce(F.col(f"`{own}`").try_cast("int"), fy)
            df = df.select(*[kept.alias(year_col) if c == own else F.col(f"`{c}`") for c in df.columns])
        frames.append(df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_all(spark: SparkSession, pattern: str, fmt: str | None = None, base_path: str | None = None,
             multiline: bool = False) -> DataFrame:
    """Every file matching a glob, with the file it came from, united by column name.

    CSV files are grouped by their header line and each group is read at once; a column that
    a file lacks is NULL for its rows. Parquet merges the files' schemas.
    """
    fmt = fmt or _format_for(pattern)
    name = F.col("_metadata.file_name").alias("source_file")
    if fmt != "csv":
        return read_table(spark, pattern, fmt, base_path=base_path).select("*", name)
    by_header: dict[str, list[str]] = {}
    for path, header in header_lines(spark, pattern).items():
        by_header.setdefault(header, []).append(path)
    frames = [read_table(spark, sorted(files), fmt, base_path=base_path, multiline=multiline).select("*", name)
              for _, files in sorted(by_header.items(), key=lambda g: min(g[1]))]
    if not frames:
        return spark.createDataFrame([], "source_file string")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


_PART, _OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
#: A file up to this size is read to its end, which keeps the task's Python worker for the next one.
_READ_ON = 32 << 20


def header_lines(spark: SparkSession, pattern: str) -> dict[str, str]:
    """The header record of every file of a glob, by path, in one job; files without a line are left out.

    A file is one task, which takes lines until the quotes of the first record are closed; a large
    file is not read further. What comes to the driver is a line for each file.
    """
    whole = str(1 << 44)  # no file is split, none shares a task
    before = {k: spark.conf.get(k) for k in (_PART, _OPEN)}

    def first_record(batches):
        import pyarrow as pa

        path, lines, closed = None, [], False
        for b in batches:
            if not b.num_rows or closed:
                continue
            path, size = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for line in b.column(2):
                lines.append(line.as_py())
                closed = sum(x.count('"') for x in lines) % 2 == 0
                if closed:
                    break
            if closed and size > _READ_ON:
                break
        if lines:
            yield pa.record_batch([[path], ["\n".join(lines)]], names=["path", "header"])

    try:
        for k in before:
            spark.conf.set(k, whole)
        rows = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")
        return {unquote(r["path"]): r["header"] for r in rows.mapInArrow(first_record, "path string, header string").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def clean_columns(df: DataFrame, underscore: bool = False) -> DataFrame:
    """Strip header names; the notebook variant also drops quotes and turns
    blanks into underscores."""
    names = []
    for c in df.columns:
        n = c.strip()
        if underscore:
            n = n.replace("'", "").replace(" ", "_")
        names.append(n)
    return df.toDF(*names)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """Export rows as CSV with a header (one folder of part files); ``compression``: "gzip" and others Spark reads back."""
    w = df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    (w.option("compression", compression) if compression else w).csv(path)


def write_merged(df: DataFrame, path: str, partition_by: str | None = "year", mode: str = "overwrite") -> None:
    """Save the merged set as parquet, partitioned by year when present so
    later year filters prune whole folders."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def replace_parts(df: DataFrame, path: str, partition_by: str = "year") -> None:
    """S6, one year again: the partitions that ``df`` holds are replaced, all others keep their files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """S6 for a set that is joined again and again: files bucketed and sorted by ``keys`` under ``path``, known to the
    catalog as ``table``. A join on ``keys`` reads it without an exchange. Returns the table."""
    spark = df.sparkSession
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (top-k, not a full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep the prepared set between queries (spills to disk when large)."""
    return df.persist(level)
