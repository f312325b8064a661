"""Plan guards: no registered query plans a Cartesian product or a nested-loop
join, and the fixture scans receive pushed filters and pruned schemas."""

import pytest

from tests.conftest import SF_SMALL

SLOW = {"m4_sell_regressors", "m4_profit_regressors", "m5_retention_classifiers", "m7_text_classifiers",
        "m14_learning_curve", "m7c_online_linear", "m15_score_retention", "m9_segments", "t3_holt_winters",
        "t3_holt_winters_by_category", "s1_read_yearly", "s2_read_all_merged", "s1_sales_sheets",
        "e2_high_value_board", "e2_sell_board"}


def _names():
    from shelfwise.plans.queries import QUERIES

    return sorted(k for k in QUERIES if k not in SLOW)


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_nested_loop(spark, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_category_filter_reaches_the_scan(spark):
    import __spark_entry__ as E

    plan = E.queries()["f1_apply_filters"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "In(p_type, [PROMO,SMALL])" in plan or "p_type IN (PROMO,SMALL)" in plan
