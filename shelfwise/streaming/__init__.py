"""Incremental dashboard aggregates over a stream of sales files.

The reference has no streaming. When new sales sheets keep arriving, the
dashboard's monthly series can be maintained incrementally with Structured
Streaming: each micro-batch is cleaned with the batch operators and reduced to
monthly partial sums (``foreachBatch``, written to its own ``batch_id=N``
folder, so a replayed batch overwrites itself: idempotent); readers combine
the partials with one small aggregate and the usual calendar/rolling operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfwise.operators.clean import numeric_safe, prepare_sales
from shelfwise.operators.filters import dashboard_defaults
from shelfwise.operators.series import resample, rolling_mean


def monthly_partials(batch: DataFrame, day_first: bool = False) -> DataFrame:
    """One micro-batch -> (month start, sell, rows) partial sums."""
    clean = numeric_safe(dashboard_defaults(prepare_sales(batch, day_first=day_first)))
    return (
        clean.where(F.col("order_date").isNotNull())
        .groupBy(F.trunc(F.col("order_date").cast("date"), "month").alias("month_start"))
        .agg(F.sum("sell").alias("sell"), F.count(F.lit(1)).alias("rows"))
    )


def start_monthly_stream(spark: SparkSession, source: str, schema: StructType, table_path: str,
                         checkpoint: str, available_now: bool = True, day_first: bool = False) -> StreamingQuery:
    """Watch ``source`` for new parquet sales files; append monthly partials to
    ``table_path``. ``checkpoint`` must be a shared, reliable folder.
    ``day_first``: the order of day and month in numeric dates, one for all batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id, overwritten on replay: a batch retried after a
        # lost executor or a restart writes the same partials again, never twice
        monthly_partials(batch, day_first).write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def monthly_from_partials(spark: SparkSession, table_path: str) -> DataFrame:
    """Calendar-complete monthly sell with 3/6-month rolling means from the partials."""
    parts = spark.read.parquet(table_path)
    monthly = parts.groupBy("month_start").agg(F.sum("sell").alias("sell"))
    series = resample(monthly, "sell", "month", date_col="month_start", name="sell")
    series = rolling_mean(series, "sell", 3, name="rolling_3")
    return rolling_mean(series, "sell", 6, name="rolling_6")
