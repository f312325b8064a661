"""The dashboard and notebook flows run end to end on the small tables."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_dashboard_tabs(spark):
    from shelfwise.plans.dashboard import Dashboard
    from shelfwise.sources import sales_view

    dash = Dashboard.from_sales(sales_view(spark, SF_SMALL))
    assert dash.options().count() > 0
    tabs = {**dash.overview(), **dash.sales(), **dash.delivery(), **dash.time_series()}
    for name, df in tabs.items():
        assert df.count() > 0, name
    assert dash.forecast(6).where(F.col("actual").isNull()).count() == 6
    dash.select(year=[1996, 1997])
    assert dash.filtered.select("year").distinct().count() == 2


def test_prepare_features_notebook(spark):
    from shelfwise.plans.notebooks import prepare_features
    from shelfwise.sources import LINE_KEY, dirty_sales_view

    d = dirty_sales_view(spark, SF_SMALL).drop("order_date_text", "sell_text")
    out = prepare_features(d, LINE_KEY)
    data = out["data"]
    assert data.count() > 0
    assert set(data.select("is_test").distinct().toPandas()["is_test"]) == {0, 1}
    assert data.where(F.col("unit_missing").isNull()).count() == 0
    assert 0 < out["threshold"]


def test_text_study(spark):
    from shelfwise.plans.notebooks import text_study
    from shelfwise.sources import texts_view

    out = text_study(texts_view(spark, SF_SMALL), max_features=2000, trees=5)
    board = out["leaderboard"].collect()
    assert {r["model"] for r in board} >= {"LinearSVC", "LogisticRegression", "RandomForest", "RidgeClassifier"}
    assert all(0.0 <= r["accuracy"] <= 1.0 for r in board)
    assert out["ensemble"].count() == 1


def test_dashboard_customers_tab(spark):
    from shelfwise.plans.dashboard import Dashboard
    from shelfwise.sources import sales_view

    tabs = Dashboard.from_sales(sales_view(spark, SF_SMALL)).customers(k=3, bins=12)
    assert tabs["segments"].count() == 3
    assert tabs["age_histogram"].count() == 12
    assert tabs["rfm"].count() == 20
    assert abs(sum(r["percent"] for r in tabs["ratings"].collect()) - 100.0) < 0.05
