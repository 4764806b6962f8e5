"""The TPC-H-like star schema seen as customers and transactions.

A line item is a transaction, the part brand its category, the order priority its payment mode and
return flag ``R`` a return. Region, market segment and nation stand in for gender, age band and city.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.operators.joins import spread_join
from tillstone.schemas import MONEY
from tillstone.sources.files import read_parquet


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet")


def star_customers(spark: SparkSession, folder: str) -> DataFrame:
    customer = star_table(spark, folder, "customer")
    nation = star_table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = star_table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        customer.join(nation.join(region, "n_regionkey"), "c_nationkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("r_name").alias("gender"),
            F.col("c_mktsegment").alias("age_group"),
            F.col("n_name").alias("city"),
        )
    )


def _over_all_cores(table: DataFrame, row_number: str) -> DataFrame:
    """Redistribute a table that comes in fewer splits than there are cores; larger ones stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, row_number) if table.rdd.getNumPartitions() < cores else table


def star_transactions(spark: SparkSession, folder: str) -> DataFrame:
    lines = star_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        "l_suppkey",
        "l_linenumber",
        F.col("l_extendedprice").cast(MONEY).alias("product_amount"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount_pct"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.monotonically_increasing_id().alias("scan_row"),
    )
    orders = star_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_orderpriority"
    )
    parts = star_table(spark, folder, "part").select(F.col("p_partkey").alias("partkey"), "p_brand")
    # orders come last: lines of an order, which are of one customer, then stand together, and totals by customer meet early
    made = spread_join(_over_all_cores(lines, "scan_row"), parts, "partkey", "scan_row", keys_from=lines)
    sold = spread_join(made, orders, "orderkey", "scan_row", keys_from=lines)

    kept = (F.lit(100) - F.col("discount_pct")).cast("decimal(3,0)") * F.lit(Decimal("0.01"))
    ship_day = F.date_format("ship_date", "yyyyMMdd")
    return sold.select(
        F.concat_ws("-", "orderkey", "l_linenumber", "partkey", "l_suppkey", ship_day).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("order_date").alias("transaction_date"),
        F.col("p_brand").alias("category"),
        "product_amount",
        "quantity",
        "discount_pct",
        F.round(F.col("product_amount") * kept, 2).cast(MONEY).alias("final_amount"),
        F.col("o_orderpriority").alias("payment_mode"),
        "returned",
    )
