"""The base tables and the intermediate tables that the reports share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone import schemas
from tillstone.functions.numbers import from_cents, to_cents
from tillstone.operators import clustering
from tillstone.operators.ordering import with_position, with_running
from tillstone.operators.quantiles import exact_quantiles
from tillstone.operators.scoring import EDGES, check_edges, score_above, score_of_position
from tillstone.operators.sizing import size_shuffles
from tillstone.operators.storage import WorkTables
from tillstone.plans.measures import monthly_totals, totals_by
from tillstone.sources.files import REJECTED, read_csv, read_csv_apart, read_parquet
from tillstone.sources.star import star_customers, star_table, star_transactions

FEATURES = {"recency": "zr", "frequency": "zf", "monetary": "zm"}
Z = list(FEATURES.values())
ATTRIBUTES = ["gender", "age_group", "city"]
CLUSTERS = 4
RESTARTS = 10
METHODS = ("kmeans", "lloyd", "mllib")

#: Columns of the transactions that reports never add up; they are written only for those that list transactions.
DETAILS = ["transaction_id", "product_amount", "quantity"]


def as_facts(transactions: DataFrame) -> DataFrame:
    """Transactions with ``counted``, which lets COUNT(transaction_id) read one bit per row, and the amount in cents."""
    counted = F.when(F.col("transaction_id").isNotNull(), True)
    cents = to_cents(F.col("final_amount"))
    return transactions.withColumns({"counted": counted, "cents": cents}).drop("final_amount")


class MissingDatesError(ValueError):
    """A customer has transactions, but none with a date."""


class Mart:
    """A snapshot of customers and transactions with the tables derived from them.

    Each shared table is written once, on first use, to the shared folder of the cluster, and every
    report reads it from there. Most reports need no more than ``profiles``, one row per customer.

    Segments come from K-means, best of ten starts; with ``clustering_method="lloyd"`` from the first start alone, and
    with ``"mllib"`` from MLlib's K-means, best of ten seeds. The first two are exact, so that plain SQL can reproduce them.
    """

    def __init__(
        self,
        spark: SparkSession,
        customers: DataFrame,
        transactions: DataFrame,
        age_bands: Sequence[str] = schemas.AGE_BANDS,
        on_duplicate_edges: str = "error",
        clustering_method: str = "kmeans",
    ):
        if on_duplicate_edges not in ("error", "merge"):
            raise ValueError("on_duplicate_edges is 'error' or 'merge'")
        if clustering_method not in METHODS:
            raise ValueError(f"clustering_method is one of {', '.join(METHODS)}")
        size_shuffles(transactions)
        self.spark = spark
        self.store = WorkTables(spark)
        self.age_bands = list(age_bands)
        self.on_duplicate_edges = on_duplicate_edges
        self.clustering_method = clustering_method
        self._customers = customers
        self._transactions = transactions
        #: Lines of CSV files that did not fit: (table_name, file, line, reason).
        self.rejected = spark.createDataFrame([], REJECTED)
        self.parsed: WorkTables | None = None
        #: Segments computed before, with the columns of ``schemas.RFM_SEGMENTS``; reports then fit none.
        self.stored_segments: DataFrame | None = None

    @classmethod
    def from_star(cls, spark: SparkSession, folder: str, **options) -> Mart:
        options.setdefault("age_bands", schemas.MARKET_SEGMENTS)
        # before the joins are laid out, which deal hot keys over as many partitions as there are
        size_shuffles(star_table(spark, folder, "lineitem"))
        return cls(spark, star_customers(spark, folder), star_transactions(spark, folder), **options)

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, on_bad_rows: str = "fail", **options) -> Mart:
        """``customers.csv`` and ``transactions.csv`` with the columns of ``tillstone.schemas``.

        A line that does not fit them stops the read, or with ``on_bad_rows="quarantine"`` goes to ``rejected``.
        """
        if on_bad_rows not in ("fail", "quarantine"):
            raise ValueError("on_bad_rows is 'fail' or 'quarantine'")
        folder = folder.rstrip("/")
        files = {"customers": schemas.CUSTOMERS, "transactions": schemas.TRANSACTIONS}
        paths = {name: f"{folder}/{name}.csv" for name in files}
        if on_bad_rows == "fail":
            return cls(spark, *(read_csv(spark, paths[name], schema) for name, schema in files.items()), **options)
        store = WorkTables(spark)
        people, odd_people = read_csv_apart(spark, paths["customers"], schemas.CUSTOMERS, store, "customers")
        facts, odd_sales = read_csv_apart(spark, paths["transactions"], schemas.TRANSACTIONS, store, "transactions", as_facts)
        sales = facts.withColumn("final_amount", from_cents(F.col("cents"))).select(*schemas.TRANSACTIONS.names)
        mart = cls(spark, people, sales, **options)
        # what was parsed is written already
        mart.customers, mart._detailed = people, facts
        mart.parsed = store
        mart.rejected = store.save(odd_people.unionAll(odd_sales), "rejected")
        return mart

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, **options) -> Mart:
        """Tables ``customers.parquet`` and ``transactions.parquet`` with the columns of ``tillstone.schemas``.

        If ``rfm_segments.parquet`` is there too, reports read the stored segments instead of fitting new ones.
        """
        folder = folder.rstrip("/")
        customers = read_parquet(spark, f"{folder}/customers.parquet", schemas.CUSTOMERS)
        transactions = read_parquet(spark, f"{folder}/transactions.parquet", schemas.TRANSACTIONS)
        mart = cls(spark, customers, transactions, **options)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rfm_segments.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            mart.stored_segments = read_parquet(spark, path.toString(), schemas.RFM_SEGMENTS)
        return mart

    @cached_property
    def customers(self) -> DataFrame:
        return self.store.save(self._customers, "customers")

    @cached_property
    def _detailed(self) -> DataFrame:
        """Facts with the ids and amounts that only lists of transactions show."""
        return self.store.save(as_facts(self._transactions), "transactions")

    @cached_property
    def facts(self) -> DataFrame:
        """Transactions as the reports read them, without their details.

        ``counted`` is non-null where ``transaction_id`` is, ``cents`` is the final amount in whole cents. If the detailed
        table is there already, it is read instead of the sources; if not, only what reports add up is read and written.
        """
        if "_detailed" in self.__dict__:
            return self._detailed.drop(*DETAILS)
        return self.store.save(as_facts(self._transactions).drop(*DETAILS), "facts")

    @property
    def transactions(self) -> DataFrame:
        """Transactions with the columns of the data model."""
        return self._detailed.withColumn("final_amount", from_cents(F.col("cents"))).select(self._transactions.columns)

    @cached_property
    def profiles(self) -> DataFrame:
        """One row per customer id: attributes, measures, first and last day.

        Rows of one customer collapse before the shuffle, so a customer with a large part of all
        transactions costs as little as any other. The outer join is done once here; reports by customer
        attribute then need neither the transactions nor a join. ``known`` marks ids of the customer
        table, ``rows`` is null for customers without transactions, and transactions without an id form a
        row of their own.
        """
        totals = totals_by(
            self.facts,
            "customer_id",
            first_date=F.min("transaction_date"),
            last_date=F.max("transaction_date"),
        )
        # an id that the customer table repeats is one customer; the join below groups by it anyway
        named = self.customers.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
        customers = named.agg(F.min(F.struct(*ATTRIBUTES)).alias("_own")).select("customer_id", "_own.*", F.lit(True).alias("known"))
        return self.store.save(customers.join(totals, "customer_id", "full"), "profiles")

    @property
    def customer_totals(self) -> DataFrame:
        """Measures of every customer id with transactions, known or not."""
        return self.profiles.where(F.col("rows").isNotNull())

    @property
    def buyers(self) -> DataFrame:
        """Measures and attributes of the known customers with transactions."""
        return self.customer_totals.where("known")

    @cached_property
    def category_totals(self) -> DataFrame:
        """One row per customer and category, for joins with customer attributes or segments."""
        known = self.facts.where(F.col("customer_id").isNotNull())
        totals = totals_by(known, "customer_id", "category").drop("flags", "returned")
        return self.store.save(totals, "category-totals")

    @cached_property
    def spend_positions(self) -> DataFrame:
        """Customers by falling revenue with their position; rows without a known id count as one customer."""
        totals = self.customer_totals.select("customer_id", "orders", "revenue")
        order = [F.desc_nulls_last("revenue"), F.col("customer_id")]
        return with_position(totals, order, self.store, "spend-positions")

    @cached_property
    def ranked_categories(self) -> DataFrame:
        """Measures per category with ``rank``, ``running`` and ``running_whole`` by falling revenue."""
        totals = totals_by(self.facts, "category")
        ranked = with_running(totals, "revenue", "category", self.store, "categories", running={"running": "revenue"})
        return self.store.save(ranked, "ranked-categories")

    @cached_property
    def month_steps(self) -> DataFrame:
        """Measures per month, one of its days, and the revenue of the month ``before``."""
        totals = monthly_totals(self.facts, day=F.min("transaction_date"))
        options = {"descending": False, "nulls_last": False, "lags": {"before": "revenue"}}
        steps = with_running(totals, "month", "month", self.store, "months", **options)
        return self.store.save(steps, "month-steps")

    @property
    def rfm(self) -> DataFrame:
        """Recency, frequency and monetary value of every customer with transactions."""
        self._check_dates()
        snapshot = self.customer_totals.agg(F.date_add(F.max("last_date"), 1)).scalar()
        measures = {
            "recency": F.date_diff(snapshot, F.col("last_date")),
            "frequency": F.col("orders"),
            "monetary": F.coalesce("revenue", F.lit(0)).cast("decimal(22,2)"),
        }
        # attributes and measures of the profile stay, so that segments need not be joined back to them
        return self.customer_totals.where(F.col("customer_id").isNotNull()).withColumns(measures)

    @cache
    def _check_dates(self) -> None:
        """A customer without a date has no recency, and no score that would be right."""
        undated = self.customer_totals.where("customer_id is not null and last_date is null").limit(3).collect()
        if undated:
            raise MissingDatesError(f"no transaction date for customers such as {[row['customer_id'] for row in undated]}")

    @cached_property
    def rfm_scores(self) -> DataFrame:
        """``rfm`` with the three quintile scores and their sum."""
        placed = with_position(self.rfm, [F.col("frequency"), F.col("customer_id")], self.store, "by-frequency")

        amounts = [F.col(name).cast("decimal(22,2)").alias(name) for name in ("recency", "monetary")]
        long = placed.select(*amounts).unpivot([], ["recency", "monetary"], "metric", "amount")
        cuts = exact_quantiles(long, "amount", EDGES, by=["metric"])

        def edges(metric: str):
            return check_edges(cuts[(metric,)], metric, self.on_duplicate_edges) if cuts else []

        recency, monetary = edges("recency"), edges("monetary")
        scored = placed.withColumns(
            {
                "R_score": F.lit(len(recency) + 2) - score_above(F.col("recency"), recency),
                "F_score": score_of_position(F.col("position"), F.col("row_count")),
                "M_score": score_above(F.col("monetary"), monetary),
            }
        )
        return scored.withColumn("RFM_score", F.col("R_score") + F.col("F_score") + F.col("M_score")).drop(
            "position", "row_count"
        )

    @cached_property
    def scaled(self) -> DataFrame:
        """``rfm_scores`` with z-scores."""
        return self.store.save(clustering.standardize(self.rfm_scores, FEATURES), "scaled")

    @cache
    def fits(self, sizes: Sequence[int], restarts: int) -> dict[tuple[int, int], clustering.Fit]:
        """K-means for every number of clusters and restart, all in the same scans."""
        starts = clustering.drawn_starts(self.scaled, "customer_id", Z, sizes, restarts)
        return clustering.lloyd_fits(self.scaled, Z, starts)

    @cached_property
    def lloyd_centres(self) -> tuple[clustering.Centre, ...]:
        """Four centres, from the first start alone."""
        return self.fits((CLUSTERS,), 1)[CLUSTERS, 0].centres

    @cached_property
    def kmeans_centres(self) -> tuple[clustering.Centre, ...]:
        """Four centres, the best of ten starts."""
        return clustering.best_of(self.fits((CLUSTERS,), RESTARTS))[CLUSTERS].centres

    @cached_property
    def mllib_clusters(self) -> DataFrame:
        """``scaled`` with the cluster of the best of ten MLlib fits, over z-scores that are not rounded."""
        raw = clustering.standardize(self.scaled, {column: f"{z}_raw" for column, z in FEATURES.items()}, None)
        vectors = clustering.assemble(raw, [f"{z}_raw" for z in Z]).persist()
        try:
            model = clustering.best_kmeans(vectors, [CLUSTERS], RESTARTS)[CLUSTERS]
            assigned = model.transform(vectors).withColumnRenamed("prediction", "cluster")
            return self.store.save(assigned.drop("features", *[f"{z}_raw" for z in Z]), "mllib")
        finally:
            vectors.unpersist()

    def clustered(self, method: str) -> DataFrame:
        """``scaled`` with the ``cluster`` that a method assigns."""
        if method == "mllib":
            return self.mllib_clusters
        centres = self.kmeans_centres if method == "kmeans" else self.lloyd_centres
        return clustering.with_nearest(self.scaled, Z, centres)

    @cached_property
    def segmented(self) -> DataFrame:
        """Scores, z-scores, cluster and segment of every customer, with attributes and measures."""
        if self.stored_segments is not None:
            scored = clustering.standardize(self.stored_segments, FEATURES)
            # one row per customer on both sides
            return self.store.save(scored.join(self.profiles, "customer_id"), "segmented")
        clusters = self.clustered(self.clustering_method)
        return self.store.save(clustering.label_clusters(clusters, schemas.TIERS, CLUSTERS), "segmented")

    @property
    def rfm_segments(self) -> DataFrame:
        return self.segmented.select(*schemas.RFM_SEGMENTS.names)

    def close(self) -> None:
        """Delete the shared tables of this mart."""
        self.store.drop()
        if self.parsed:
            self.parsed.drop()


_open: dict[tuple[str, str], Mart] = {}


def open_mart(spark: SparkSession, folder: str) -> Mart:
    """The mart over a folder of star tables, one per application and folder, with repeatable segments.

    A mart is a snapshot; call ``forget_marts`` after the files have changed.
    """
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _open:
        _open[key] = Mart.from_star(spark, folder, clustering_method="lloyd")
    return _open[key]


def forget_marts() -> None:
    """Close all marts that ``open_mart`` keeps, with their work tables."""
    while _open:
        _, mart = _open.popitem()
        mart.close()
