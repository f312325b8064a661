"""The dashboard's tabs (E1) as lazy DataFrames over one prepared sales set.

    dash = Dashboard.from_sales(raw_sales)          # or Dashboard.from_files(spark, paths)
    dash.select(year=[2024], category=ALL)          # sidebar filters
    tabs = dash.overview()                          # {'kpis': df, 'monthly': df, 'top_books': df}

Each method returns a dict of DataFrames; nothing is collected. The prepared
set is persisted once (the dashboard's cache) and reused by every tab.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators import aggs, series
from shelfwise.operators.clean import numeric_safe, prepare_sales
from shelfwise.operators.filters import ALL, DASHBOARD_DIMS, apply_filters, dedup_orders, filter_options
from shelfwise.operators.forecast import holt_winters_fitted
from shelfwise.operators.trend import changepoint_forecast
from shelfwise.operators.models import segment
from shelfwise.sources.io import logical_names, read_yearly, write_csv


class Dashboard:
    def __init__(self, prepared: DataFrame, order: list[str] | None = None):
        self.order = order  # which line of an order comes first
        self.prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
        self.filtered = numeric_safe(apply_filters(self.prepared, **{d: ALL for d in DASHBOARD_DIMS}))

    @classmethod
    def from_sales(cls, raw: DataFrame, order: list[str] | None = None) -> "Dashboard":
        return cls(prepare_sales(raw), order)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str], multiline: bool = False) -> "Dashboard":
        """Yearly sheets with their own headers (``sources.io.HEADERS``)."""
        return cls.from_sales(logical_names(read_yearly(spark, paths, multiline=multiline, row_key=True)))

    # sidebar ------------------------------------------------------------------
    def options(self) -> DataFrame:
        return filter_options(self.prepared)

    def select(self, **lists) -> "Dashboard":
        """Sidebar filters: IN-lists per dimension, ``ALL`` or ``None``."""
        chosen = {d: lists.get(d, ALL) for d in DASHBOARD_DIMS}
        self.filtered = numeric_safe(apply_filters(self.prepared, **chosen))
        return self

    # tabs ---------------------------------------------------------------------
    def overview(self, top_n: int = 10) -> dict[str, DataFrame]:
        orders = dedup_orders(self.filtered, self.order)
        monthly = series.rolling_mean(series.rolling_mean(series.monthly_sales(orders), "sell", 3, name="rolling_3"),
                                      "sell", 6, name="rolling_6")
        return {"kpis": aggs.kpis(orders), "monthly": monthly,
                "top_books": aggs.top_n(orders, "book", "unit", top_n, "units_sold")}

    def sales(self) -> dict[str, DataFrame]:
        return {"yearly": series.yoy(self.filtered), "by_category": aggs.sum_by(self.filtered, "category", "sell"),
                "season": aggs.season(self.filtered)}

    def delivery(self) -> dict[str, DataFrame]:
        return {"delivery": aggs.value_counts(self.filtered, "delivery"),
                "profit_by_category": aggs.sum_by(self.filtered, "category", "profit")}

    def customers(self, k: int = 3, bins: int = 20) -> dict[str, DataFrame]:
        out = {"retention_by_gender": aggs.retention_by(self.filtered, "gender"),
               "age_histogram": aggs.histogram(self.filtered, "age", bins),
               "ratings": aggs.rating_distribution(self.filtered),
               "rfm": aggs.rfm(self.filtered, n=20)}
        _, out["segments"] = segment(self.filtered, ["age", "unit", "sell", "profit"], k=k)
        return out

    def time_series(self) -> dict[str, DataFrame]:
        monthly = series.resample(self.filtered, "sell", "month", name="sell")
        monthly = series.rolling_mean(series.rolling_mean(monthly, "sell", 3, name="rolling_3"), "sell", 6,
                                      name="rolling_6")
        return {"monthly": monthly, "decomposition": series.decompose(monthly.select("period_end", "sell"), "sell", 12),
                "heatmap": aggs.year_month_pivot(self.filtered)}

    def forecast(self, months: int = 6, method: str = "holt_winters") -> DataFrame:
        monthly = series.resample(self.filtered, "sell", "month", name="sell")
        if method == "holt_winters":
            return holt_winters_fitted(monthly, "sell", h=months)[0]
        return changepoint_forecast(monthly, "sell", h=months)[0]

    def download(self, path: str) -> None:
        write_csv(self.filtered, path)
