"""The streamed monthly series equals the batch one."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark, tmpdir_fresh):
    from shelfwise.operators.clean import numeric_safe, prepare_sales
    from shelfwise.operators.filters import dashboard_defaults
    from shelfwise.operators.series import resample
    from shelfwise.sources import sales_view
    from shelfwise.streaming import monthly_from_partials, start_monthly_stream

    s = sales_view(spark, SF_SMALL)
    src = os.path.join(tmpdir_fresh, "incoming")
    for y in [r["year"] for r in s.select("year").distinct().collect()]:
        s.where(F.col("year") == y).write.mode("append").parquet(src)
    q = start_monthly_stream(spark, src, s.schema, os.path.join(tmpdir_fresh, "partials"),
                             os.path.join(tmpdir_fresh, "ckpt"))
    q.awaitTermination(300)
    got = {r["period_end"]: r["sell"] for r in monthly_from_partials(spark, os.path.join(tmpdir_fresh, "partials")).collect()}
    batch = resample(numeric_safe(dashboard_defaults(prepare_sales(s))), "sell", "month", name="sell")
    want = {r["period_end"]: r["sell"] for r in batch.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)
