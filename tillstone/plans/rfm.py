"""Recency, frequency and monetary value: scores, clusters and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.functions.numbers import half_up, money, percent, thousands
from tillstone.functions.shapes import in_label_order, over_all
from tillstone.operators import clustering
from tillstone.operators.quantiles import box_stats
from tillstone.plans.mart import CLUSTERS, FEATURES, RESTARTS, Mart, Z
from tillstone.schemas import RFM_SEGMENTS, TIERS


def rfm_base(mart: Mart) -> DataFrame:
    return mart.rfm.select(
        "customer_id",
        F.col("recency").cast("bigint").alias("recency"),
        "frequency",
        money(F.col("monetary")).alias("monetary"),
    )


def _with_edge_types(customers: DataFrame) -> DataFrame:
    """Integers as bigint and money as double, the types every report uses."""
    wide = {
        name: F.col(name).cast("bigint")
        for name in ("recency", "R_score", "F_score", "M_score", "RFM_score", "cluster")
        if name in customers.columns
    }
    return customers.withColumns({**wide, "monetary": money(F.col("monetary"))})


def rfm_scores(mart: Mart) -> DataFrame:
    return _with_edge_types(
        mart.scaled.select(
            "customer_id", "recency", "frequency", "monetary", "R_score", "F_score", "M_score", "RFM_score"
        )
    )


def rfm_scaled(mart: Mart) -> DataFrame:
    return mart.scaled.select("customer_id", *Z)


SIZES = tuple(range(2, 9))


def kmeans_sweep(mart: Mart, sizes: Sequence[int] = SIZES, restarts: int = RESTARTS) -> DataFrame:
    """Cost and silhouette of the best of several starts for every K."""
    best = clustering.best_of(mart.fits(tuple(sizes), restarts))
    scores = clustering.silhouette_means(mart.scaled, Z, best)
    rows = [(k, round(fit.inertia, 6), round(scores[k], 6)) for k, fit in sorted(best.items())]
    return mart.spark.createDataFrame(rows, "k bigint, inertia double, silhouette double")


def mllib_sweep(mart: Mart, sizes: Sequence[int] = SIZES, restarts: int = RESTARTS) -> DataFrame:
    """The same by MLlib, a fit per K and seed."""
    raw = clustering.standardize(mart.scaled.select("customer_id", *FEATURES), FEATURES, None)
    vectors = clustering.assemble(raw, Z).persist()
    try:
        models = clustering.best_kmeans(vectors, sizes, restarts)
        rows = [
            (k, float(model.summary.trainingCost), float(clustering.silhouette_score(model, vectors)))
            for k, model in sorted(models.items())
        ]
    finally:
        vectors.unpersist()
    return mart.spark.createDataFrame(rows, "k bigint, inertia double, silhouette double")


def kmeans_segments(mart: Mart) -> DataFrame:
    """Segments from the best of ten K-means starts with four clusters."""
    labelled = clustering.label_clusters(mart.clustered("kmeans"), TIERS, CLUSTERS)
    return _with_edge_types(labelled.select(*RFM_SEGMENTS.names))


def lloyd_segments(mart: Mart) -> DataFrame:
    return mart.segmented.select("customer_id", F.col("cluster").cast("bigint").alias("cluster"), "segment")


def silhouette_by_cluster(mart: Mart) -> DataFrame:
    scored = clustering.silhouettes(mart.segmented, Z, "cluster")
    return (
        scored.groupBy(F.col("cluster").cast("bigint").alias("cluster"))
        .agg(F.count("*").alias("customers"), F.round(F.avg("silhouette"), 6).alias("silhouette"))
        .orderBy("cluster")
    )


def cluster_summary(mart: Mart) -> DataFrame:
    return (
        mart.rfm_segments.groupBy(F.col("cluster").cast("bigint").alias("cluster"), "segment")
        .agg(
            *[half_up(F.sum(name), F.count(name)).alias(f"avg_{name}") for name in FEATURES],
            F.count("customer_id").alias("customer_count"),
        )
        .orderBy("cluster")
    )


def segment_totals(mart: Mart) -> DataFrame:
    """Customers and spend per segment."""
    return mart.rfm_segments.groupBy("segment").agg(F.count("*").alias("n"), F.sum("monetary").alias("spend"))


def segment_distribution(mart: Mart) -> DataFrame:
    pct = percent(F.col("n"), over_all(F.sum("n")), 1).alias("pct")
    return segment_totals(mart).select("segment", "n", pct).orderBy(F.desc("n"), "segment")


def segment_revenue_share(mart: Mart) -> DataFrame:
    pct = percent(F.col("spend"), over_all(F.sum("spend")), 1).alias("pct")
    shares = segment_totals(mart).select("segment", money(F.col("spend")).alias("revenue"), pct)
    return shares.orderBy(F.desc("revenue"), "segment")


def segment_report(mart: Mart) -> DataFrame:
    """Customers, revenue and share per segment; a segment without customers counts zero."""
    pct = percent(F.col("spend"), over_all(F.sum("spend")), 1)
    shares = segment_totals(mart).withColumn("pct", pct)
    return in_label_order(shares, "segment", TIERS).select(
        "segment",
        F.coalesce("n", F.lit(0)).alias("customers"),
        F.coalesce(money(F.col("spend")), F.lit(0.0)).alias("revenue"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
    )


def freq_vs_monetary(mart: Mart) -> DataFrame:
    return mart.rfm_segments.select(
        "customer_id", "segment", "frequency", thousands(F.col("monetary")).alias("monetary_thousands")
    )


def segment_box_stats(mart: Mart) -> DataFrame:
    """Box-plot numbers per segment and metric: quartiles, whiskers within 1.5 IQR, outliers beyond."""
    wide = mart.rfm_segments.select("segment", *[F.col(name).cast("decimal(22,2)").alias(name) for name in FEATURES])
    long = wide.unpivot("segment", list(FEATURES), "metric", "amount")
    boxes = box_stats(long, "amount", ["segment", "metric"], mart.store, "boxes")
    cuts = ("least", "q1", "med", "q3", "most", "whisker_lo", "whisker_hi")
    return boxes.select("segment", "metric", *[F.round(name, 4).alias(name) for name in cuts], "outliers").orderBy(
        "segment", "metric"
    )
