"""Reports over a hand-made shop: empty groups, unknown customers, gaps and ties."""

import datetime
import glob
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from shop import PEOPLE, SALES, rows, shop

from tillstone.operators.scoring import RepeatedEdgesError
from tillstone.plans import boards, checks, eda, rfm, sales, views
from tillstone.plans import mart as mart_module
from tillstone.plans.mart import MissingDatesError
from tillstone.schemas import TIERS


@pytest.fixture(scope="module")
def mart(spark):
    return shop(spark)


def test_summary_counts_everyone_and_everything(mart):
    total = sum(Decimal(sale[3]) for sale in SALES)
    assert rows(eda.eda_summary(mart)) == [(9, 15, float(total), round(float(total) / 15, 2), 13.3)]


def test_kpis_leave_out_unknown_customers(mart):
    row = views.vw_kpi_summary(mart).first()
    assert (row["total_customers"], row["total_transactions"]) == (9, 14)
    assert row["total_revenue"] == float(sum(Decimal(sale[3]) for sale in SALES[:-1]))
    assert row["champions"] + row["loyal_customers"] + row["at_risk"] + row["lost_inactive"] == 8


def test_kpis_of_segments_count_buyers_only(mart):
    assert boards.dash_kpis(mart).first()["total_customers"] == 9  # eight known buyers and one unknown


def test_dataframe_reports_drop_missing_labels(mart):
    assert [row[0] for row in rows(eda.revenue_by_city(mart))] == ["Surat", "Pune", "Delhi"]
    assert None not in [row[0] for row in rows(eda.revenue_by_gender(mart))]
    assert rows(eda.payment_mode_distribution(mart)) == [("Card", 8, 57.1), ("UPI", 5, 35.7), ("Wallet", 1, 7.1)]
    assert {row[0] for row in rows(eda.revenue_by_category(mart))} == {"Books", "Toys"}


def test_sql_reports_keep_missing_labels(mart):
    assert None in [row[0] for row in rows(views.vw_city_performance(mart))]
    assert None in [row[0] for row in rows(views.vw_category_performance(mart))]


def test_fixed_order_lists_absent_labels(mart):
    got = rows(eda.revenue_by_age_group(mart))
    assert [row[0] for row in got] == mart.age_bands
    assert got[-1] == ("55+", None, None)


def test_month_without_sales(mart):
    assert [row[0] for row in rows(eda.monthly_revenue(mart))] == ["2024-01", "2024-02", "2024-04"]
    assert rows(checks.date_spine_revenue(mart))[2] == ("2024-03", 0.0)


def test_growth_compares_with_the_previous_listed_month(mart):
    got = rows(sales.mom_growth(mart))
    assert got[0][2:] == (None, None)
    assert got[2][2] == got[1][1]


def test_growth_after_a_month_that_sold_nothing(spark):
    day = datetime.date
    free = [("C1", day(2024, 1, 1), "Books", "0.00", "UPI", 0), ("C1", day(2024, 2, 1), "Books", "5.00", "UPI", 0)]
    assert rows(sales.mom_growth(shop(spark, sales=free)))[1] == ("2024-02", 5.0, 0.0, None)


def test_recency_starts_at_one(mart):
    recency = {row["customer_id"]: row["recency"] for row in rfm.rfm_base(mart).collect()}
    assert recency["C1"] == 1  # bought on the last day
    assert "C9" not in recency and recency["X1"] == 11


def test_cohorts_follow_the_first_purchase(mart):
    got = {row["cohort_month"]: row for row in sales.cohort_revenue(mart).collect()}
    assert {month: row["customers"] for month, row in got.items()} == {"2024-01": 4, "2024-02": 3, "2024-04": 2}
    assert got["2024-01"]["total_revenue"] == 1069.02
    assert got["2024-01"]["avg_order_value"] == 133.63


def test_equal_totals_share_rank_and_running_total(spark):
    people = [(f"C{i}", "Male", "18-25", "Pune") for i in range(5)]
    day = datetime.date(2024, 1, 1)
    amounts = ["30.00", "20.00", "20.00", "20.00", "5.00"]
    bought = [(f"C{i}", day, "Books", amount, "UPI", 0) for i, amount in enumerate(amounts)]
    got = rows(sales.top20_customers(shop(spark, people, bought), k=3))
    assert [(row[0], row[5], row[6]) for row in got] == [("C0", 1, 30.0), ("C1", 2, 90.0), ("C2", 2, 90.0)]


def test_equal_categories_share_rank_and_cumulative_share(spark):
    day = datetime.date(2024, 1, 1)
    bought = [("C1", day, name, amount, "UPI", 0) for name, amount in [("a", "50"), ("b", "25"), ("c", "25")]]
    got = [(row[0], row[4], row[5]) for row in rows(sales.category_cumulative(shop(spark, sales=bought)))]
    assert got == [("a", 1, 50.0), ("b", 2, 100.0), ("c", 2, 100.0)]


def test_every_customer_is_in_one_segment(mart):
    segments = mart.rfm_segments.collect()
    assert len(segments) == len({row["customer_id"] for row in segments}) == 9
    means = {}
    for row in segments:
        means.setdefault(row["segment"], []).append(row["monetary"])
        assert row["RFM_score"] == row["R_score"] + row["F_score"] + row["M_score"]
    ordered = [sum(means[tier]) / len(means[tier]) for tier in TIERS]
    assert ordered == sorted(ordered, reverse=True)


def test_shares_add_up(mart):
    for table, column in [
        (rfm.segment_revenue_share(mart), "pct"),
        (sales.segment_contribution(mart), "revenue_pct"),
        (sales.quintile_pareto(mart), "revenue_pct"),
        (rfm.segment_distribution(mart), "pct"),
    ]:
        assert sum(row[column] for row in table.collect()) == pytest.approx(100, abs=0.3)
    assert max(row["cumulative_pct"] for row in sales.category_cumulative(mart).collect()) == 100


def test_quintile_sizes(mart):
    assert [row["customers"] for row in sales.quintile_pareto(mart).collect()] == [2, 2, 2, 2, 1]


def test_box_stats_cover_every_customer(mart):
    got = rfm.segment_box_stats(mart).collect()
    assert len(got) == 3 * len({row["segment"] for row in got})
    for row in got:
        assert row["least"] <= row["q1"] <= row["med"] <= row["q3"] <= row["most"]
        assert row["least"] <= row["whisker_lo"] <= row["whisker_hi"] <= row["most"]


def test_key_checks(mart, spark):
    assert rows(checks.fk_check(mart)) == [
        ("transactions", "customers", "customer_id", 1, 1),
        ("rfm_segments", "customers", "customer_id", 1, 1),
    ]
    assert all(row["duplicate_keys"] == 0 for row in checks.pk_check(mart).collect())
    from tillstone.operators.quality import pk_check

    twice = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id int")
    assert rows(pk_check(twice, ["id"], "t")) == [("t", "id", 5, 2, 1)]


def test_domain_check(spark):
    broken = [("C1", datetime.date(2024, 1, 1), "c" * 31, "-5.00", "UPI", 2)]
    got = {row["rule"]: row["violations"] for row in checks.domain_check(shop(spark, sales=broken)).collect()}
    assert {rule for rule, count in got.items() if count} == {"category_length", "returned_flag", "amount_sign"}


def test_column_profile(mart):
    got = {row["column_name"]: row for row in checks.column_profile(mart).collect()}
    assert got["category"]["nulls"] == 1 and got["category"]["distincts"] == 2
    assert got["category"]["width"] == len("category") + 4
    assert got["final_amount"]["distincts"] == 14


def test_repeated_edges_stop_the_scores(spark):
    people = [(f"C{i}", "Male", "18-25", "Pune") for i in range(10)]
    day = datetime.date(2024, 1, 1)
    same = [(f"C{i}", day, "Books", "10.00", "UPI", 0) for i in range(10)]
    with pytest.raises(RepeatedEdgesError):
        shop(spark, people, same).rfm_scores
    merged = shop(spark, people, same, on_duplicate_edges="merge").rfm_scores.collect()
    assert {(row["R_score"], row["M_score"]) for row in merged} == {(1, 1)}


def test_transactions_without_a_customer_id(spark):
    nameless = [*SALES, (None, datetime.date(2024, 4, 29), "Toys", "1000.00", "UPI", 0)]
    mart = shop(spark, PEOPLE, nameless)
    assert eda.eda_summary(mart).first()["transactions"] == 16
    assert mart.rfm.count() == 9
    assert sum(row["customers"] for row in sales.quintile_pareto(mart).collect()) == 10
    assert sum(row["customers"] for row in sales.cohort_revenue(mart).collect()) == 9


@pytest.mark.parametrize("customers", [4, 5, 8])
def test_as_few_customers_as_clusters(spark, customers):
    people = [(f"C{i}", "Male", "18-25", "Pune") for i in range(customers)]
    bought = [
        (f"C{i}", datetime.date(2024, 1, 1 + i), "Books", f"{10 ** i}.00", "UPI", 0) for i in range(customers)
    ]
    assert shop(spark, people, bought).rfm_segments.count() == customers


def test_too_few_customers(spark):
    mart = shop(spark, PEOPLE[:2], [sale for sale in SALES if sale[0] in ("C1", "C3")])
    with pytest.raises(ValueError, match="too few customers"):
        mart.lloyd_centres


def test_skew_report(mart):
    got = {row["top_pct"]: row for row in checks.skew_report(mart).collect()}
    assert got[1]["customers"] == 1 and got[1]["revenue"] == 900.0
    assert got[50]["customers"] == 5


def test_sample_and_arms(mart):
    assert checks.sample_customers(mart).count() == 1
    assert checks.weighted_bucket(mart).count() == 9


def test_a_customer_without_a_date_stops_the_scores(spark):
    for method in ("lloyd", "kmeans"):
        undated = shop(spark, sales=[*SALES, ("C9", None, "Books", "1.00", "Card", 0)], clustering_method=method)
        with pytest.raises(MissingDatesError, match="C9"):
            rfm.rfm_scores(undated)


def test_a_buyer_without_spend_is_ranked_last(spark):
    people = [(f"C{i}", "Male", "18-25", "Pune") for i in range(8)]
    day = datetime.date(2024, 1, 1)
    bought = [(f"C{i}", day, "Books", f"{10 + i}.00", "UPI", 0) for i in range(7)]
    mart = shop(spark, people, bought)
    unpaid = mart._transactions.limit(1).select(
        *[F.lit("C7").alias(c) if c == "customer_id" else F.lit(None).cast("decimal(12,2)").alias(c) if c == "final_amount" else c for c in mart._transactions.columns]
    )
    mart._transactions = mart._transactions.union(unpaid)
    got = rows(sales.top20_customers(mart))
    assert len(got) == 8
    assert [row[0] for row in got][-1] == "C7" and got[-1][5] == 8


def test_discounts_outside_the_columns_are_kept(spark):
    mart = shop(spark)
    wide = mart._transactions.limit(1).select("*", F.explode(F.sequence(F.lit(-2), F.lit(1000))).alias("_d"))
    mart._transactions = wide.withColumn("discount_pct", F.col("_d").cast("int")).drop("_d")
    (row,) = eda.category_discount_pivot(mart).collect()
    assert list(row.asDict()) == ["category", *[f"d{percent}" for percent in range(101)], "other"]
    assert all(row[f"d{percent}"] == 100.0 for percent in range(101))
    other = json.loads(row["other"])
    assert list(map(int, other)) == [-2, -1, *range(101, 1001)] and set(other.values()) == {100.0}
    assert eda.category_discount_means(mart).count() == 1003
    assert eda.category_discount_pivot(shop(spark)).where("other is not null").isEmpty()


def test_an_id_given_twice_is_one_customer(spark):
    twice = [*PEOPLE, ("C5", "Female", "18-25", "Pune")]
    once, more = views.vw_kpi_summary(shop(spark)).first(), views.vw_kpi_summary(shop(spark, twice)).first()
    assert once == more and once["total_customers"] == 9


def test_forgotten_marts_leave_nothing(spark):
    kept = mart_module.open_mart(spark, "/root/testdata/sf0.001")
    assert kept.profiles.count() > 0
    mart_module.forget_marts()
    assert not glob.glob(kept.store.folder)
