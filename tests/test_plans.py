"""Physical plans: pruned scans, no Python, no whole table in one task."""

import re

import pytest

from tillstone.plans.mart import open_mart
from tillstone.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"kmeans_sweep", "kmeans_segments"}


def plan(table, mode: str = "formatted") -> str:
    return table._jdf.queryExecution().explainString(
        table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SLOW))
def test_plan_nodes(spark, key):
    """No Python, no product of tables, and only grouped rows meet in a single task."""
    text = plan(QUERIES[key](spark, FOLDER), "simple")
    for node in ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text, node
    nodes = [line.lstrip(" :+-") for line in text.splitlines()]
    for index, node in enumerate(nodes):
        if node.startswith("Exchange SinglePartition"):
            below = next(name for name in nodes[index + 1 :] if not name.startswith(("Project", "Filter", "Generate")))
            assert re.match(r"(Hash|ObjectHash|Sort)Aggregate|LocalLimit|Window", below), (key, below)


@pytest.mark.parametrize(
    "key", ["revenue_by_category", "payment_mode_distribution", "monthly_revenue", "bi_by_category"]
)
def test_fact_scans_read_only_what_they_need(spark, key):
    schemas = re.findall(r"ReadSchema: (.*)", plan(QUERIES[key](spark, FOLDER)))
    assert schemas and all(schema.count(":") <= 5 and "transaction_id" not in schema for schema in schemas)


def test_no_month_text_per_transaction(spark):
    nodes = plan(QUERIES["monthly_revenue"](spark, FOLDER), "simple").splitlines()
    scan = next(i for i, node in enumerate(nodes) if "FileScan" in node)
    first_aggregate = next(i for i in range(scan, 0, -1) if "HashAggregate" in nodes[i])
    assert not any("date_format" in node for node in nodes[first_aggregate : scan + 1])


@pytest.mark.parametrize(
    "key", ["revenue_by_city", "cohort_revenue", "vw_kpi_summary", "segment_demographics_export", "vw_rfm_segments"]
)
def test_customer_reports_need_no_join(spark, key):
    assert "Join" not in plan(QUERIES[key](spark, FOLDER))


def test_high_value_filter_reaches_the_scan(spark):
    assert "In(segment, [Champions,Loyal Customers])" in plan(QUERIES["vw_high_value_customers"](spark, FOLDER))


def test_large_sides_are_not_broadcast(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    from tillstone.sources.star import star_transactions

    text = plan(star_transactions(spark, FOLDER), "simple")
    assert "_hand" in text
    # orders and parts; the bounded table of frequent keys may be broadcast
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 2


def test_star_transactions_are_the_same_either_way(spark, settings):
    expected = open_mart(spark, FOLDER).transactions
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    from tillstone.sources.star import star_transactions

    spread = star_transactions(spark, FOLDER)
    assert spread.count() == expected.count() == 6000
    assert spread.exceptAll(expected).count() == 0
