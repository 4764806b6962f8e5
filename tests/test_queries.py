"""Every query against its SQL counterpart in DuckDB, and the shape of the rest."""

import compare
import pytest

import __spark_entry__ as contract
from tillstone.oracle import ORACLE_SQL as ORACLE
from tillstone.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
DUCK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


@pytest.fixture(scope="module")
def duck():
    with compare.connect(FOLDER) as con:
        yield con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equals_sql(spark, duck, key):
    columns, types, rows = compare.spark_rows(QUERIES[key](spark, FOLDER))
    other_columns, other_types, other_rows = compare.oracle_rows(duck, ORACLE[key])
    assert {name: DUCK_TYPES.get(kind) for name, kind in other_types.items()} == types
    assert compare.canonical(columns, rows) == compare.canonical(other_columns, other_rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).count() == 20


def test_kmeans_segments(spark):
    rows = QUERIES["kmeans_segments"](spark, FOLDER).collect()
    assert len({row["customer_id"] for row in rows}) == len(rows) == 1500
    spend = {}
    for row in rows:
        spend.setdefault(row["segment"], []).append(row["monetary"])
    means = [sum(values) / len(values) for values in (spend[tier] for tier in contract_tiers())]
    assert means == sorted(means, reverse=True)


def contract_tiers():
    from tillstone.schemas import TIERS

    return TIERS


def test_sweep_beside_mllib(spark):
    """The same costs as MLlib's fits, or lower ones, but for what a few starts may miss."""
    from tillstone.plans import rfm
    from tillstone.plans.mart import open_mart

    mart = open_mart(spark, FOLDER)
    ours = {row["k"]: row for row in rfm.kmeans_sweep(mart).collect()}
    theirs = {row["k"]: row for row in rfm.mllib_sweep(mart, sizes=(2, 4), restarts=2).collect()}
    for k, row in theirs.items():
        assert ours[k]["inertia"] <= row["inertia"] * 1.02
        assert 0 < ours[k]["silhouette"] < 1
    costs = [ours[k]["inertia"] for k in sorted(ours)]
    assert costs == sorted(costs, reverse=True)
    assert mart.clustered("mllib").groupBy("cluster").count().count() == 4
