"""Calendar-complete time series, rolling windows, growth, decomposition.

Raw rows are first reduced to one value per (keys, period) by a partially
aggregated ``groupBy``; the calendar is generated per series with ``sequence``
from that series' own first and last period (no cross join), and windows run
over the reduced series, partitioned by the series keys. A series is tens to
thousands of periods, so each window partition is bounded whatever the row
count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQS = ("day", "week", "month", "year")


def _period_start(date_col: Column, freq: str) -> Column:
    d = date_col.cast("date")
    if freq == "day":
        return d
    if freq == "week":  # Spark weeks start on Monday
        return F.date_trunc("week", date_col).cast("date")
    if freq == "month":
        return F.trunc(d, "month")
    if freq == "year":
        return F.trunc(d, "year")
    raise ValueError(f"freq must be one of {FREQS}")


def _period_end(start: Column, freq: str) -> Column:
    """pandas labels a bin by its end: month end, Sunday, Dec 31, the day itself."""
    if freq == "day":
        return start
    if freq == "week":
        return F.date_add(start, 6)
    if freq == "month":
        return F.last_day(start)
    return F.date_add(F.add_months(start, 12), -1)


def _step(freq: str) -> Column:
    return {
        "day": F.expr("INTERVAL 1 DAY"),
        "week": F.expr("INTERVAL 7 DAY"),
        "month": F.expr("INTERVAL 1 MONTH"),
        "year": F.expr("INTERVAL 12 MONTH"),
    }[freq]


def resample(df: DataFrame, value: Column | str, freq: str = "month", date_col: str = "order_date",
             keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """Sum of ``value`` per period, every period from the series' first to
    its last present, empty periods 0. Output: keys..., period_end, name."""
    keys = keys or []
    v = F.col(value) if isinstance(value, str) else value
    start = _period_start(F.col(date_col), freq).alias("_ps")
    agg = (
        df.select(*keys, start, v.alias("_v"))
        .where(F.col("_ps").isNotNull())
        .groupBy(*keys, "_ps")
        .agg(F.sum("_v").alias("_v"))
    )
    # each period is followed by the empty ones before the next: linear in the calendar, and the
    # aggregated input is used once
    nxt = F.lead("_ps").over(_w(keys, "_ps"))
    run = F.when(F.col("_n").isNull(), F.array("_ps")).otherwise(
        F.slice(F.sequence("_ps", "_n", _step(freq)), F.lit(1), F.size(F.sequence("_ps", "_n", _step(freq))) - 1))
    cal = agg.withColumn("_n", nxt).select(*keys, "_ps", "_v", F.explode(run).alias("_p"))
    return cal.select(
        *keys,
        _period_end(F.col("_p"), freq).alias("period_end"),
        F.when(F.col("_p") == F.col("_ps"), F.coalesce(F.col("_v"), F.lit(0.0))).otherwise(F.lit(0.0)).alias(name),
    )


def monthly_sales(orders: DataFrame, date_col: str = "order_date", keys: list[str] | None = None) -> DataFrame:
    """Monthly sum of sell x unit (orders as de-duplicated by F4)."""
    v = F.coalesce(F.col("sell"), F.lit(0.0)) * F.col("unit")
    return resample(orders, v, "month", date_col, keys, name="sell")


def _w(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def rolling_mean(series: DataFrame, col: str, n: int, order: str = "period_end", keys: list[str] | None = None,
                 name: str | None = None) -> DataFrame:
    """Mean of the last ``n`` values, NULL until ``n`` values exist."""
    w = _w(keys or [], order).rowsBetween(-(n - 1), 0)
    m = F.when(F.count(col).over(w) == n, F.avg(col).over(w))
    return series.withColumn(name or f"rolling_{n}", m)


def pct_change(series: DataFrame, col: str, order: str, keys: list[str] | None = None, name: str = "pct") -> DataFrame:
    """(x - previous) / previous x 100; a zero or missing base gives NULL."""
    prev = F.lag(col).over(_w(keys or [], order))
    return series.withColumn(name, F.when(prev != 0, (F.col(col) - prev) / prev * 100))


def yoy(df: DataFrame, measure: str = "sell", keys: list[str] | None = None) -> DataFrame:
    """Yearly total and its growth over the previous present year, in %."""
    keys = keys or []
    yearly = (
        df.where(F.col("year").isNotNull())
        .groupBy(*keys, "year")
        .agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(f"total_{measure}"))
    )
    return pct_change(yearly, f"total_{measure}", "year", keys, "yoy_pct")


def mom(series: DataFrame, col: str = "sell", keys: list[str] | None = None) -> DataFrame:
    """Month-over-month growth in % over a calendar-complete monthly series."""
    return pct_change(series, col, "period_end", keys, "mom_pct")


def require_history(series: DataFrame, periods: int, what: str) -> DataFrame:
    """T5: a single series needs ``periods`` points; returns the series (nothing is kept in memory)."""
    have = series.limit(periods).count()
    if have < periods:
        raise ValueError(f"{what} needs at least {periods} periods, the series has {have}")
    return series


def _trend(col: str, period: int, w: Window) -> Column:
    """Centred moving average: 2 x p for even p (end weights 1/2p), plain p for odd."""
    half = period // 2
    if period % 2 == 0:
        inner = F.sum(col).over(w.rowsBetween(-(half - 1), half - 1))
        ends = F.lag(col, half).over(w) + F.lead(col, half).over(w)
        return (inner + ends / 2) / period
    full = w.rowsBetween(-half, half)
    return F.when(F.count(col).over(full) == period, F.avg(col).over(full))


def decompose(series: DataFrame, col: str, period: int = 12, order: str = "period_end",
              keys: list[str] | None = None, extrapolate: bool = False, min_periods: int | None = None) -> DataFrame:
    """Additive decomposition into trend, seasonal, residual.

    trend: centred moving average; seasonal: mean of the detrended values per
    phase (position mod period), re-centred to mean 0; resid = x - trend - seasonal.
    ``extrapolate=True`` fills the trend's ends with least-squares lines through
    the ``period`` nearest trend points at each end. Series shorter than
    ``min_periods`` (default 2 x period) are left out (T5).
    """
    keys = keys or []
    min_periods = min_periods or 2 * period
    if not keys:
        series = require_history(series, min_periods, "seasonal decomposition")
    w = _w(keys, order)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    s = series.select(*keys, order, col)
    s = s.withColumn("_idx", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    s = s.where(F.col("_n") >= min_periods)
    s = s.withColumn("trend", _trend(col, period, w))
    if extrapolate:
        t_idx = F.when(F.col("trend").isNotNull(), F.col("_idx"))
        s = s.withColumn("_front", F.min(t_idx).over(whole)).withColumn("_back", F.max(t_idx).over(whole))
        front_last = F.least(F.col("_front") + period, F.col("_back"))
        back_first = F.greatest(F.col("_front"), F.col("_back") - period)
        in_front = (F.col("_idx") >= F.col("_front")) & (F.col("_idx") < front_last)
        in_back = (F.col("_idx") >= back_first) & (F.col("_idx") < F.col("_back"))
        y_f, y_b = F.when(in_front, F.col("trend")), F.when(in_back, F.col("trend"))
        x = F.col("_idx").cast("double")
        s = (
            s.withColumn("_kf", F.regr_slope(y_f, x).over(whole))
            .withColumn("_nf", F.regr_intercept(y_f, x).over(whole))
            .withColumn("_kb", F.regr_slope(y_b, x).over(whole))
            .withColumn("_nb", F.regr_intercept(y_b, x).over(whole))
        )
        s = s.withColumn(
            "trend",
            F.when(F.col("_idx") < F.col("_front"), F.col("_kf") * x + F.col("_nf"))
            .when(F.col("_idx") > F.col("_back"), F.col("_kb") * x + F.col("_nb"))
            .otherwise(F.col("trend")),
        )
    s = s.withColumn("_phase", F.col("_idx") % period).withColumn("_detr", F.col(col) - F.col("trend"))
    # phase means and their mean, with windows only (the series is used once):
    # each row adds pm / rows-in-its-phase, so the sum over a series is the sum
    # of its phase means; dividing by the number of phases gives their mean
    by_phase = Window.partitionBy(*keys, "_phase")
    s = s.withColumn("_pm", F.avg("_detr").over(by_phase)).withColumn("_pc", F.count(F.lit(1)).over(by_phase))
    s = s.withColumn("_pn", F.size(F.collect_set("_phase").over(whole)))
    mean_pm = F.sum(F.col("_pm") / F.col("_pc")).over(whole) / F.col("_pn")
    out = s.withColumn("seasonal", F.col("_pm") - mean_pm)
    return out.select(
        *keys,
        order,
        col,
        "trend",
        "seasonal",
        (F.col(col) - F.col("trend") - F.col("seasonal")).alias("resid"),
    )
