"""Bounds on what one Arrow batch carries to a Python worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16777216") -> None:
    """Batches of at most ``rows`` rows and about ``size`` bytes, unless the session says less.

    Texts differ in length by a factor of thousands, so a bound on rows alone does not
    bound a worker's memory.
    """
    if int(spark.conf.get(ROWS, "10000")) > rows:
        spark.conf.set(ROWS, str(rows))
    if int(spark.conf.get(BYTES, str(2**31 - 1))) > int(size):
        spark.conf.set(BYTES, size)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes (or one larger one); empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.nbytes for h in held) + b.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        if len(b):
            held.append(b)
    if held:
        yield pa.concat_batches(held)
