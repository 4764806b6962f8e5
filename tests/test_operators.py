"""Distributed operators against plain windows and brute force."""

import hashlib
import os
import statistics
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillstone.functions.numbers import half_up, sum_cents
from tillstone.functions.text import hash_bucket, padded_id, weighted_label
from tillstone.operators import clustering, quality, sampling, sizing
from tillstone.operators.histogram import equal_width
from tillstone.operators.joins import frequent_keys, join_totals, spread_join
from tillstone.operators.ordering import tile, top_ranked, with_position, with_running
from tillstone.operators.quantiles import box_stats, exact_quantiles, group_quantiles, interpolated
from tillstone.operators.sampling import draw_share
from tillstone.operators.scoring import EDGES, RepeatedEdgesError, check_edges, score_above, score_of_position
from tillstone.operators.sizing import fits_broadcast
from tillstone.operators.storage import WorkTables, shared_folder
from tillstone.plans.mart import Mart
from tillstone.sources.star import star_transactions


@pytest.fixture(scope="module")
def store(spark):
    return WorkTables(spark)


def skewed(spark, n=4000):
    """A third of the rows share one value, the rest are spread over a few hundred."""
    value = F.when(F.col("id") % 3 == 0, 77).otherwise((F.col("id") * 7919) % 400)
    return spark.range(0, n, 1, 6).select(F.col("id"), value.cast("bigint").alias("v"))


def test_position_equals_row_number(spark, store, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="9")
    table = skewed(spark)
    placed = with_position(table, [F.desc("v"), F.col("id")], store, "t")
    expected = table.withColumn("position", F.row_number().over(Window.orderBy(F.desc("v"), "id")))
    expected = expected.select("id", "v", F.lit(4000), "position")
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, expected.collect()))
    assert len(placed.inputFiles()) > 4
    sizes = [spark.read.parquet(path).count() for path in placed.inputFiles()]
    assert max(sizes) < 4000 / 3  # the shared value did not end up in one part


@pytest.mark.parametrize("n", [1, 3, 5, 7, 11, 100])
def test_tile_equals_ntile(spark, n):
    table = spark.range(n).withColumn("position", F.row_number().over(Window.orderBy("id")))
    both = table.select(
        tile(F.col("position"), F.lit(n), 5).alias("ours"), F.ntile(5).over(Window.orderBy("id")).alias("theirs")
    )
    assert all(row["ours"] == row["theirs"] for row in both.collect())


def running_cases():
    source = np.random.default_rng(4)
    tied = [(at, None if at % 9 == 0 else int(source.integers(0, 4)), at % 11 or None) for at in range(200)]
    return {
        "ties over parts": tied,
        "one value": [(at, 5, 1) for at in range(120)],
        "only nulls": [(at, None, None) for at in range(50)],
        "distinct": [(at, at * 7 % 101, at) for at in range(101)],
        "negative": [(at, at % 5 - 2, -at) for at in range(60)],
        "one row": [(1, 2, 3)],
        "empty": [],
    }


@pytest.mark.parametrize("case", list(running_cases()))
@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("nulls_last", [True, False])
def test_running_equals_plain_windows(spark, store, settings, case, descending, nulls_last):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="9")
    table = spark.createDataFrame(running_cases()[case], "id int, v int, x int")
    got = with_running(
        table, "v", "id", store, "running", descending=descending, nulls_last=nulls_last,
        running={"so_far": "x", "values": "v"}, lags={"previous": "x", "value_before": "v"},
    )
    side = F.desc_nulls_last if nulls_last else F.desc_nulls_first
    if not descending:
        side = F.asc_nulls_last if nulls_last else F.asc_nulls_first
    order, rows_in_order = Window.orderBy(side("v")), Window.orderBy(side("v"), "id")
    wanted = table.select(
        "*",
        F.rank().over(order).cast("bigint").alias("rank"),
        F.sum("x").over(order).alias("so_far"),
        F.sum("v").over(order).alias("values"),
        F.sum("x").over(Window.partitionBy()).alias("so_far_whole"),
        F.sum("v").over(Window.partitionBy()).alias("values_whole"),
        F.lag("x").over(rows_in_order).alias("previous"),
        F.lag("v").over(rows_in_order).alias("value_before"),
    )
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_running_over_millions_of_groups(spark, store, settings):
    """Five million categories, a third of them of one revenue: no task holds more than its part."""
    settings(spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false")
    n = 5_000_000
    value = F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000)))
    table = spark.range(n).select(F.col("id").alias("category"), value.cast("bigint").alias("revenue"))
    got = with_running(table, "revenue", "category", store, "many", running={"so_far": "revenue"}, lags={"before": "revenue"})
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text
    parts = store.spark.read.parquet(f"{store.folder}/many-????????").groupBy(F.shiftright("_row", 33))
    sizes = [row["count"] for row in parts.count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16
    checks = got.agg(
        F.max("so_far"), F.max("so_far_whole"), F.min("rank"), F.count_if(F.col("before").isNull()),
        F.count_if(F.col("before") < F.col("revenue")), F.count_distinct(F.when(F.col("revenue") == 77, F.col("rank"))),
    ).first()
    whole = table.agg(F.sum("revenue")).first()[0]
    assert tuple(checks) == (whole, whole, 1, 1, 0, 1)


@pytest.mark.parametrize("k", [1, 4, 20, 9999])
def test_top_ranked_equals_windows(spark, k):
    table = skewed(spark, 600).withColumn("v", F.col("v").cast("decimal(22,2)"))
    falling = Window.orderBy(F.desc("v"))
    expected = (
        table.withColumn("rank", F.rank().over(falling))
        .withColumn("running_total", F.sum("v").over(falling))
        .orderBy(F.desc("v"), "id")
        .limit(k)
    )
    got = top_ranked(table, "v", "id", k).select("id", "v", "rank", "running_total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_top_ranked_ties_at_the_cut(spark):
    table = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate([9, 5, 5, 5, 1])], "id int, v decimal(22,2)")
    got = sorted(tuple(row) for row in top_ranked(table, "v", "id", 2).select("id", "rank", "running_total").collect())
    assert got == [(0, 1, Decimal(9)), (1, 2, Decimal(24))]  # the total includes the peers beyond the cut


def test_top_ranked_empty(spark):
    assert top_ranked(spark.createDataFrame([], "id int, v decimal(22,2)"), "v", "id", 3).count() == 0


def test_quantiles_equal_numpy(spark):
    table = skewed(spark).withColumn("g", F.col("id") % 3)
    table = table.withColumn("d", (F.col("v") * 1000003 % 99991).cast("decimal(14,2)") / F.lit(1)).withColumn(
        "d", F.col("d").cast("decimal(14,2)")
    )
    probabilities = [Fraction(k, 20) for k in range(21)]
    frame = table.toPandas()
    for by in ([], ["g"]):
        cuts = exact_quantiles(table, "d", probabilities, by)
        groups = [((), frame)] if not by else [((key,), part) for key, part in frame.groupby("g")]
        assert len(cuts) == len(groups)
        for key, part in groups:
            expected = np.quantile(part["d"].astype(float), [float(p) for p in probabilities])
            assert np.allclose([float(q.value) for q in cuts[key]], expected, rtol=1e-12)


def test_quantiles_ignore_nulls_and_empty(spark):
    table = spark.createDataFrame([(None,), (-5,), (7,), (None,), (7,)], "v bigint")
    assert exact_quantiles(table, "v", [Fraction(1, 2)])[()][0].value == 7
    assert exact_quantiles(table, "v", [Fraction(0), Fraction(1, 4)])[()][1].value == 1
    assert exact_quantiles(table.where("v is null"), "v", [Fraction(1, 2)]) == {}


def test_quantiles_of_a_wide_range(spark):
    values = [-(10**15), -3, 0, 1, 2, 10**15, 10**15 + 1]
    table = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert exact_quantiles(table, "v", [Fraction(1, 2)])[()][0].value == statistics.median(values)


def test_scores_equal_qcut(spark):
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(1, 100000, 997)]
    table = spark.createDataFrame([(v,) for v in values], "v bigint")
    edges = check_edges(exact_quantiles(table, "v", EDGES)[()], "v", "error")
    got = {row["v"]: row["s"] for row in table.select("v", score_above(F.col("v"), edges).alias("s")).collect()}
    expected = pd.qcut(pd.Series(values), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert [got[v] for v in values] == list(expected)


@pytest.mark.parametrize("n", [7, 10, 11, 1500])
def test_position_scores_equal_qcut(spark, n):
    table = spark.range(1, n + 1)
    got = [row[0] for row in table.orderBy("id").select(score_of_position(F.col("id"), F.lit(n))).collect()]
    assert got == list(pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int))
    if n == 7:
        assert got == [1, 1, 2, 3, 4, 5, 5]


def test_repeated_edges(spark):
    table = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 1, 2, 3, 4]], "v bigint")
    cut = exact_quantiles(table, "v", EDGES)[()]
    with pytest.raises(RepeatedEdgesError):
        check_edges(cut, "v", "error")
    merged = check_edges(cut, "v", "merge")
    assert [float(edge.value) for edge in merged] == [pytest.approx(1.2), pytest.approx(2.6)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, settings, how):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    big = skewed(spark).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "v", F.when(F.col("id") == 5, None).otherwise(F.col("v"))
    )
    # key 77 is in the other table twice, key 3 is missing
    other = spark.range(400).where("id <> 3").select(F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    other = other.unionAll(other.where("v = 77"))
    assert not fits_broadcast(other)
    joined = spread_join(big, other, "v", "row", how)
    assert "_hand" in joined._jdf.queryExecution().toString()
    expected = big.join(other, "v", how)
    columns = expected.columns
    key = lambda row: [(value is not None, value) for value in row]
    assert sorted(map(tuple, joined.select(columns).collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


def test_spread_join_splits_the_frequent_key(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )
    big = skewed(spark).withColumn("row", F.monotonically_increasing_id())
    other = spark.range(400).select(F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    loads = spread_join(big, other, "v", "row").groupBy(F.spark_partition_id()).count().collect()
    assert max(row["count"] for row in loads) < 4000 / 3 / 2


def test_small_side_is_left_to_catalyst(spark):
    other = spark.range(10).withColumnRenamed("id", "v")
    assert fits_broadcast(other)


def test_histogram(spark):
    values = [0.0, 1.0, 2.5, 9.99, 10.0, 10.0, 5.0]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = equal_width(table, "v", 10).collect()
    expected, edges = np.histogram(values, bins=10)
    assert [row["n"] for row in got] == list(expected)
    assert np.allclose([row["lo"] for row in got], edges[:-1])


def test_histogram_of_a_constant(spark):
    got = equal_width(spark.createDataFrame([(4.0,)] * 3, "v double"), "v", 4).collect()
    assert [row["n"] for row in got] == list(np.histogram([4.0] * 3, bins=4)[0])


def drawn_by_sorting(keys, share):
    order = sorted(keys, key=lambda key: (key is not None, key is not None and hashlib.md5(str(key).encode()).hexdigest(), key))
    return sorted(map(str, order[: int(len(keys) * share)]))


@pytest.mark.parametrize("share", [0.0, 0.003, 0.2, 0.999, 1.0])
def test_draw_share(spark, share, monkeypatch):
    keys = [*range(1000), None, None]
    frame = spark.createDataFrame([(key,) for key in keys], "id bigint").repartition(3)
    for bits in (16, 8, 4):  # coarse slices leave more rows to the last one
        monkeypatch.setattr(sampling, "BITS", bits)
        drawn = [row["id"] for row in draw_share(frame, "id", share).collect()]
        assert sorted(map(str, drawn)) == drawn_by_sorting(keys, share)


def test_draw_share_neither_sorts_nor_writes(spark):
    drawn = draw_share(spark.range(100_000), "id", 0.2)
    text = drawn._jdf.queryExecution().executedPlan().toString()
    assert drawn.count() == 20_000 and "Sort" not in text.replace("TakeOrderedAndProject", "")
    assert draw_share(spark.range(0), "id", 0.2).count() == 0


@pytest.mark.parametrize("met_by_chance", [False, True])
def test_key_check_by_hashes(spark, monkeypatch, met_by_chance):
    if met_by_chance:
        monkeypatch.setattr(quality, "short_hash", lambda *values: F.pmod(F.xxhash64(*values), F.lit(3)))
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 1), ("c", 7), ("c", 7), (None, 1), ("d", None), (None, None)]
    frame = spark.createDataFrame(rows, "k string, n int")
    assert [tuple(row) for row in quality.pk_check(frame, ["k", "n"], "t").collect()] == [("t", "k,n", 10, 3, 2)]
    assert [tuple(row) for row in quality.pk_check(frame, ["k"], "t").collect()] == [("t", "k", 10, 2, 3)]
    assert [tuple(row) for row in quality.pk_check(frame.limit(0), ["k"], "t").collect()] == [("t", "k", 0, 0, 0)]


@pytest.mark.parametrize("met_by_chance", [False, True])
def test_profile_by_hashes(spark, monkeypatch, met_by_chance):
    if met_by_chance:
        monkeypatch.setattr(quality, "short_hash", lambda *values: F.pmod(F.xxhash64(*values), F.lit(4)))
    rows = [(at % 7, None if at % 5 else f"text {at % 13}", Decimal(at % 3), f"{at:040}") for at in range(90)]
    frame = spark.createDataFrame(rows, "a int, `b.c` string, d decimal(5,2), wide string")
    got = [tuple(row) for row in quality.column_profile(frame).collect()]
    texts = {row[1] for row in rows if row[1]}
    assert got == [
        (1, "a", 5, 0, 7),
        (2, "b.c", max(map(len, texts)) + 4, 72, len(texts)),
        (3, "d", 8, 0, 3),
        (4, "wide", 30, 0, 90),
    ]
    assert [tuple(row)[2:] for row in quality.column_profile(frame.limit(0)).collect()] == [(5, 0, 0), (7, 0, 0), (5, 0, 0), (8, 0, 0)]


def quantile_groups(frame, probabilities, store, name="quantiles"):
    found = group_quantiles(frame, "x", probabilities, ["g", "h"], store, name)
    value = interpolated(F.col("lower"), F.col("upper"), F.col("part"), F.col("whole"))
    return {(row["g"], row["h"], row["place"]): row["v"] for row in found.withColumn("v", value).collect()}


def test_quantiles_of_many_groups(spark, store, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="7")
    source = np.random.default_rng(2)
    rows = [(None if g == 3 else g, "h" if g % 2 else None, int(x)) for g in range(40) for x in source.integers(-50, 50, 1 + g)]
    rows += [(1000, "hot", int(x)) for x in source.integers(0, 3, 2000)] + [(5, "h", None), (2000, "empty", None)]
    frame = spark.createDataFrame(rows, "g int, h string, x int").repartition(5)
    probabilities = [Fraction(0), Fraction(1, 4), Fraction(1, 3), Fraction(9, 10), Fraction(1)]
    groups = {}
    for g, h, x in rows:
        if x is not None:
            groups.setdefault((g, h), []).append(x)
    wanted = {(*group, at): np.quantile(xs, float(p)) for group, xs in groups.items() for at, p in enumerate(probabilities)}
    got = quantile_groups(frame, probabilities, store)
    assert got.keys() == wanted.keys()
    assert all(got[key] == pytest.approx(wanted[key], abs=1e-9) for key in wanted)
    assert not quantile_groups(frame.limit(0), probabilities, store, "nothing")


def test_box_statistics_of_a_million_groups(spark, store):
    """Groups 0..n of the values g, g + 1, ..., g + 6 and one outlier; the driver sees no more than counts."""
    n = 1_000_000
    outlier = F.when(F.col("k") == 7, F.col("g") + 1000)
    frame = spark.range(8 * n).select((F.col("id") % n).alias("g"), F.floor(F.col("id") / n).alias("k"))
    frame = frame.select("g", F.coalesce(outlier, F.col("g") + F.col("k")).alias("x"))
    boxes = box_stats(frame, "x", ["g"], store, "many")
    shape = [F.col(name) - F.col("g") for name in ("least", "q1", "med", "q3", "most", "whisker_lo", "whisker_hi")]
    counts = boxes.groupBy(F.array(*shape).alias("shape"), "outliers").count().collect()
    assert [(row["shape"], row["outliers"], row["count"]) for row in counts] == [([0.0, 1.75, 3.5, 5.25, 1000.0, 0.0, 6.0], 1, n)]


def test_frequent_keys_have_no_bound_but_the_partitions(spark):
    """A key of 0.009 % of the rows fills nine tasks of 100,000 and is dealt out; its hands stay within twice the median."""
    n, partitions = 2_000_000, 100_000
    table = spark.range(n).select(F.when(F.col("id") < 180, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    (found,) = frequent_keys(table, "k", partitions).collect()
    assert found["k"] == -1 and found["_hands"] == 36
    loads = table.where("k = -1").groupBy(F.pmod(F.xxhash64("row"), F.lit(found["_hands"]))).count().collect()
    assert max(row["count"] for row in loads) <= 2 * n // partitions


@pytest.mark.parametrize("most", [2, 5, 1 << 16])
def test_totals_meet_rows_of_frequent_and_rare_keys(spark, store, most):
    rows = [(at if at % 3 else (1 if at % 2 else None), "x" if at % 7 else None, at) for at in range(100)]
    frame = store.save(spark.createDataFrame(rows, "k bigint, h string, x bigint"), "frame")
    totals = frame.groupBy("k", "h").agg(F.sum("x").alias("total"), F.count("*").alias("n")).where("k is null or k != 2")
    wanted = {}
    for key, other, x in rows:
        wanted[key, other] = wanted.get((key, other), 0) + x
    found = join_totals(frame, store.save(totals, "totals"), ["k", "h"], "n", most)
    assert found.columns == ["k", "h", "x", "total"]
    expected = [(k, h, x, wanted[k, h]) for k, h, x in rows if k != 2]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_half_up(spark):
    cases = [(Decimal("100.01"), 2, 50.01), (Decimal("-100.01"), 2, -50.01), (Decimal("1"), 3, 0.33), (Decimal("5"), 0, None)]
    table = spark.createDataFrame([case[:2] for case in cases], "a decimal(22,2), b bigint")
    assert [row[0] for row in table.select(half_up(F.col("a"), F.col("b"))).collect()] == [case[2] for case in cases]


def test_sum_cents(spark):
    values = [999999999999, -999999999999, 5, -7, 123456789, None, 999999999999]
    table = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert table.agg(sum_cents(F.col("v"))).first()[0] == Decimal(sum(v for v in values if v is not None)) / 100
    assert table.where("v is null").agg(sum_cents(F.col("v"))).first()[0] is None


def test_text_functions(spark):
    table = spark.createDataFrame([(7,), (12345,)], "n bigint")
    assert [row[0] for row in table.select(padded_id("CUST", F.col("n"), 4)).collect()] == ["CUST0007", "CUST12345"]
    labels = spark.range(20000).select(weighted_label(hash_bucket(F.col("id")), {"a": 0.5, "b": 0.3, "c": 0.2}).alias("l"))
    shares = {row["l"]: row["count"] / 20000 for row in labels.groupBy("l").count().collect()}
    assert shares == {"a": pytest.approx(0.5, abs=0.02), "b": pytest.approx(0.3, abs=0.02), "c": pytest.approx(0.2, abs=0.02)}
    with pytest.raises(ValueError):
        weighted_label(F.lit(1), {"a": 0.5})


def blobs(spark):
    rng = np.random.default_rng(3)
    centres = [(0, 0), (6, 0), (0, 7), (9, 9)]
    points = [(float(x + rng.normal()), float(y + rng.normal()), i) for i, (x, y) in enumerate(centres) for _ in range(60)]
    return spark.createDataFrame(points, "x double, y double, blob int")


def test_silhouettes_equal_the_evaluator(spark):
    points = blobs(spark)
    ours = clustering.silhouettes(points, ["x", "y"], "blob").agg(F.avg("silhouette")).first()[0]
    vectors = clustering.assemble(points, ["x", "y"])
    theirs = ClusteringEvaluator(predictionCol="blob", metricName="silhouette").evaluate(vectors)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_silhouette_of_a_single_member(spark):
    points = spark.createDataFrame([(0.0, 0), (0.5, 0), (9.0, 1)], "x double, c int")
    got = {row["x"]: row["silhouette"] for row in clustering.silhouettes(points, ["x"], "c").collect()}
    assert got[9.0] == 0 and got[0.0] > 0.9


def test_lloyd_finds_the_blobs(spark):
    points = blobs(spark)
    start = [tuple(place * clustering.UNIT for place in centre) for centre in [(1, 1), (5, 1), (1, 5), (8, 8)]]
    fit = clustering.lloyd_fits(points, ["x", "y"], {"only": start})["only"]
    clusters = points.withColumn("c", clustering.nearest(["x", "y"], fit.centres)).groupBy("blob", "c").count()
    assert clusters.count() == 4


def test_lloyd_keeps_an_empty_centre(spark):
    points = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    fit = clustering.lloyd_fits(points, ["x"], {0: [(400_000,), (99_000_000,)]})[0]
    assert fit.centres == ((500_000,), (99_000_000,)) and fit.cost == 2 * 500_000**2 and fit.inertia == 0.5


def plain_lloyd(points, centres, most_steps=300):
    """(centres, cost, steps) by whole numbers, one run at a time."""
    centres, steps = [tuple(centre) for centre in centres], 0
    while True:
        squares = ((points[:, None, :] - np.array(centres)[None, :, :]) ** 2).sum(axis=2)
        chosen, cost, steps = squares.argmin(axis=1), int(squares.min(axis=1).sum()), steps + 1
        after = []
        for cluster, centre in enumerate(centres):
            own = points[chosen == cluster]
            after.append(tuple((2 * int(total) + len(own)) // (2 * len(own)) for total in own.sum(axis=0)) if len(own) else centre)
        moved = sum((new - old) ** 2 for one, other in zip(after, centres) for new, old in zip(one, other))
        if moved <= clustering.SETTLED or steps >= most_steps:
            return tuple(centres), cost, steps
        centres = after


@pytest.mark.parametrize("most_steps", [1, 3, 300])
def test_all_runs_in_the_same_scans(spark, most_steps):
    points = blobs(spark)
    units = np.round(np.array([(row["x"], row["y"]) for row in points.collect()]) * clustering.UNIT).astype(np.int64)
    source = np.random.default_rng(8)
    starts = {
        (size, turn): [tuple(map(int, units[at])) for at in source.choice(len(units), size, replace=False)]
        for size in (1, 2, 5, 9)
        for turn in range(3)
    }
    starts["equal starts"] = [starts[1, 0][0]] * 3
    for table in (points, points.repartition(7)):
        fits = clustering.lloyd_fits(table, ["x", "y"], starts, most_steps)
        assert list(fits) == list(starts)
        for key, fit in fits.items():
            assert (fit.centres, fit.cost, fit.steps) == plain_lloyd(units, starts[key], most_steps)


def test_best_of_several_starts(spark):
    points = blobs(spark).withColumn("id", F.monotonically_increasing_id())
    starts = clustering.drawn_starts(points, "id", ["x", "y"], [2, 4], 6)
    assert len(starts) == 12 and all(len(set(start)) == size for (size, _), start in starts.items())
    assert starts == clustering.drawn_starts(points.repartition(5), "id", ["x", "y"], [2, 4], 6)
    fits = clustering.lloyd_fits(points, ["x", "y"], starts)
    best = clustering.best_of(fits)
    assert all(best[size].cost == min(fits[size, turn].cost for turn in range(6)) for size in (2, 4))
    means = clustering.silhouette_means(points, ["x", "y"], best)
    for size, fit in best.items():
        assigned = points.withColumn("c", clustering.nearest(["x", "y"], fit.centres))
        theirs = clustering.silhouettes(assigned, ["x", "y"], "c").agg(F.avg("silhouette")).first()[0]
        assert means[size] == pytest.approx(theirs, abs=1e-6)
    with pytest.raises(ValueError, match="too few"):
        clustering.drawn_starts(points.limit(3), "id", ["x", "y"], [4], 2)


def test_fits_without_points_and_with_far_ones(spark):
    empty = spark.createDataFrame([], "x double")
    assert clustering.lloyd_fits(empty, ["x"], {0: [(1,), (2,)]})[0] == clustering.Fit(((1,), (2,)), 0, 1)
    far = spark.createDataFrame([(1e9,), (1e9 + 2,), (-1e9,)], "x double")
    fit = clustering.lloyd_fits(far, ["x"], {0: [(0,), (10**15,)]})[0]
    assert fit.centres == ((-(10**15),), (10**15 + 10**6,)) and fit.inertia == 2.0


def test_best_kmeans_has_the_lowest_cost(spark):
    vectors = clustering.assemble(blobs(spark), ["x", "y"]).persist()
    best = clustering.best_kmeans(vectors, [3, 4], restarts=3)
    singles = [clustering.best_kmeans(vectors, [4], restarts=1, seed=seed)[4] for seed in (42, 43, 44)]
    assert best[4].summary.trainingCost == pytest.approx(min(model.summary.trainingCost for model in singles))
    assert best[4].summary.trainingCost < best[3].summary.trainingCost
    assert clustering.silhouette_score(best[4], vectors) > 0.7
    vectors.unpersist()


def test_standardize(spark):
    table = spark.createDataFrame([(1, 5), (3, 5)], "a int, b int")
    got = clustering.standardize(table, {"a": "za", "b": "zb"}).orderBy("a").collect()
    assert [(row["za"], row["zb"]) for row in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_labels_need_enough_names(spark):
    with pytest.raises(ValueError):
        clustering.label_clusters(spark.range(1), ["only"], 2)


class BareSession:
    """A session whose cluster names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    def __init__(self, master):
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")
    local = BareSession("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(BareSession("yarn"))


def test_superseded_tables_are_deleted(spark, tmp_path):
    tables = WorkTables(spark)
    first = tables.save(spark.range(5), "numbers")
    other = tables.save(spark.range(3), "other")
    second = tables.replace(first.where("id > 1"), "numbers")
    third = tables.replace(second.where("id > 2"), "numbers")
    assert third.count() == 2 and other.count() == 3
    paths = [table.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/") for table in (third, other)]
    assert sorted(os.listdir(os.path.dirname(paths[0]))) == sorted(map(os.path.basename, paths))
    tables.discard("other", "never saved")
    assert os.listdir(os.path.dirname(paths[0])) == [os.path.basename(paths[0])]
    tables.drop()
    assert not os.path.exists(os.path.dirname(paths[0]))


def test_shuffles_grow_with_the_input(spark, settings, monkeypatch):
    settings(**{sizing.INITIAL.replace(".", "__"): "5"})
    scan = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    monkeypatch.setattr(sizing, "BYTES_PER_PARTITION", sizing.planned_bytes(scan) // 37)
    sizing.size_shuffles(scan)
    assert sizing.shuffle_partitions(spark) == 5  # the choice of the user
    spark.conf.unset(sizing.INITIAL)
    sizing.size_shuffles(scan)
    assert sizing.shuffle_partitions(spark) == 37
    assert "hashpartitioning(l_orderkey" in (
        text := scan.groupBy("l_orderkey").count()._jdf.queryExecution().toString()
    ) and ", 37)" in text
    spark.conf.unset(sizing.INITIAL)
    monkeypatch.setattr(sizing, "BYTES_PER_PARTITION", 1 << 40)
    sizing.size_shuffles(scan)
    assert spark.conf.get(sizing.INITIAL, None) is None


def test_a_join_counts_its_inputs_not_their_product(spark, settings):
    settings(**{sizing.INITIAL.replace(".", "__"): "5"})
    spark.conf.unset(sizing.INITIAL)
    folder = "/root/testdata/sf0.1"
    sold = star_transactions(spark, folder)
    tables = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("lineitem", "orders", "part")]
    assert 0 < sizing.scanned_bytes(sold) <= sum(map(sizing.planned_bytes, tables)) < sizing.planned_bytes(sold)
    Mart.from_star(spark, folder).close()
    assert spark.conf.get(sizing.INITIAL, None) is None


def test_partitions_stay_within_an_int(spark, settings, monkeypatch):
    settings(**{sizing.INITIAL.replace(".", "__"): "5"})
    spark.conf.unset(sizing.INITIAL)
    monkeypatch.setattr(sizing, "scanned_bytes", lambda table: 1 << 59)
    sizing.size_shuffles(spark.range(3))
    assert sizing.shuffle_partitions(spark) == sizing.MOST_PARTITIONS
    spark.conf.unset(sizing.INITIAL)


def test_a_larger_input_raises_the_number_set_for_a_smaller_one(spark, settings, monkeypatch):
    settings(**{sizing.INITIAL.replace(".", "__"): "5"})
    spark.conf.unset(sizing.INITIAL)
    scan = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    for partitions in (10, 103, 50):
        monkeypatch.setattr(sizing, "BYTES_PER_PARTITION", sizing.planned_bytes(scan) // partitions)
        sizing.size_shuffles(scan)
        assert sizing.shuffle_partitions(spark) == max(103, partitions) if partitions != 10 else 10
    spark.conf.unset(sizing.INITIAL)


def unequal(spark, settings, partitions):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__enabled="false",
        spark__sql__shuffle__partitions=str(partitions),
    )


def test_a_key_just_above_one_task_is_split(spark, settings):
    unequal(spark, settings, 200)
    # one key holds nine tasks' rows and still less than a twentieth of all
    big = spark.range(40_000).select(
        F.when(F.col("id") % 22 == 0, 7).otherwise(F.col("id") % 9_000 + 10).alias("v"), F.col("id").alias("row")
    )
    other = spark.range(10_000).select(F.col("id").alias("v"))
    joined = spread_join(big, other, "v", "row")
    loads = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(row["count"] for row in loads) == 40_000
    assert max(row["count"] for row in loads) < 2.2 * 200


def test_rows_without_a_key_are_dealt_out(spark, settings):
    unequal(spark, settings, 16)
    big = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"), F.col("id").alias("row"))
    other = spark.range(40_000).select(F.col("id").alias("v"), F.lit(1).alias("w"))
    joined = spread_join(big, other, "v", "row", "left")
    loads = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(row["count"] for row in loads) == 40_000
    assert max(row["count"] for row in loads) < 1.5 * 40_000 / 16


def test_rows_without_a_value_share_the_last_rank(spark):
    from tillstone.operators.ordering import top_ranked

    rows = [(name, None if value is None else Decimal(value)) for name, value in zip("abcdefgh", [5, 9, None, 9, 1, None, 3, 2], strict=True)]
    table = spark.createDataFrame(rows, "name string, v decimal(12,2)")
    got = [(r["name"], r["rank"], float(r["running_total"])) for r in top_ranked(table, "v", "name", 20).orderBy("rank", "name").collect()]
    assert got == [
        ("b", 1, 18), ("d", 1, 18), ("a", 3, 23), ("g", 4, 26), ("h", 5, 28), ("e", 6, 29), ("c", 7, 29), ("f", 7, 29),
    ]
    assert top_ranked(table, "v", "name", 6).count() == 6


def test_csv_columns_by_name(spark, tmp_path):
    from tillstone import schemas
    from tillstone.sources.files import read_csv

    def written(name, header, row):
        (tmp_path / name).write_text(f"{header}\n{row}\n")
        return str(tmp_path / name)

    swapped = written("swapped.csv", "customer_id,city,age_group,gender,signup_date", "C1,Pune,18-25,Male,2024-01-02")
    row = read_csv(spark, swapped, schemas.CUSTOMERS).first()
    assert (row["city"], row["gender"], row["age_group"]) == ("Pune", "Male", "18-25")
    missing = written("missing.csv", "customer_id,city,age_group,gender", "C1,Pune,18-25,Male")
    extra = written("extra.csv", "customer_id,city,age_group,gender,signup_date,note", "C1,Pune,18-25,Male,2024-01-02,x")
    for path, problem in ((missing, "signup_date"), (extra, "note")):
        with pytest.raises(ValueError, match=problem):
            read_csv(spark, path, schemas.CUSTOMERS)


def test_nearest_works_distances_out_once(spark, store):
    points = store.save(blobs(spark).withColumn("monetary", F.col("x").cast("decimal(22,2)")), "points")
    centres = [(1, 1), (5_000_000, 1_000_000), (5_000_000, 1_000_000), (8_000_000, 8_000_000)]
    found = clustering.with_nearest(points, ["x", "y"], centres)
    assert found.where(F.col("cluster") != clustering.nearest(["x", "y"], centres)).isEmpty()
    assert sorted(found.columns) == sorted([*points.columns, "cluster"])
    labelled = clustering.label_clusters(found, ["a", "b", "c", "d"], 4)
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    # each coordinate is rounded once for the rows and once for the profile
    assert plan.count("round(") == 4


def test_a_step_of_kmeans_adds_up_before_the_shuffle(spark, store):
    rows = [(10**15 + at, -at) for at in range(1000)] + [(0, 0)]
    points = store.save(spark.createDataFrame(rows, "x bigint, y bigint").repartition(3), "far-points")
    found = clustering._tallied(points, ["x", "y"], {0: [(10**15, 0), (0, 0)], 1: [(0, 0)]})
    assert {key: (row["n"], row["x"], row["y"]) for key, row in found.items()} == {
        (0, 0): (1000, 1000 * 10**15 + 499_500, -499_500), (0, 1): (1, 0, 0), (1, 0): (1001, 1000 * 10**15 + 499_500, -499_500)
    }
    with pytest.raises(Exception, match="too large to be clustered"):
        clustering._tallied(spark.createDataFrame([(1 << 52,)], "x bigint"), ["x"], {0: [(0,)]})


def test_work_tables_are_small_on_disk(spark, store):
    assert all(".zstd." in path for path in store.save(spark.range(10), "small").inputFiles())


def test_no_key_is_counted_where_no_slice_is_full(spark, store, tmp_path):
    frame = store.save(spark.range(200_000).select((F.col("id") % 50_000).alias("k")), "even")
    spark.sparkContext.setJobGroup("even", "")
    tracker = spark.sparkContext.statusTracker()
    assert frequent_keys(frame, "k", 8) is None
    held = store.save(frame.union(frame.limit(1).select(F.lit(-7).cast("bigint")).crossJoin(spark.range(50_000)).drop("id")), "held")
    before = len(tracker.getJobIdsForGroup("even"))
    (found,) = frequent_keys(held.toDF("k"), "k", 8).collect()
    assert found["k"] == -7 and len(tracker.getJobIdsForGroup("even")) > before
    nulls = store.save(spark.range(100).select(F.lit(None).cast("bigint").alias("k")), "nulls")
    assert frequent_keys(nulls, "k", 8) is None and frequent_keys(nulls.limit(0), "k", 8) is None
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
