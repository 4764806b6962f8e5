"""Table schemas and the fixed label domains of the retail data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("gender", T.StringType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("signup_date", T.DateType()),
    ]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("product_amount", MONEY),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("discount_pct", T.IntegerType()),
        T.StructField("final_amount", MONEY),
        T.StructField("payment_mode", T.StringType()),
        T.StructField("returned", T.IntegerType()),
    ]
)

RFM_SEGMENTS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("recency", T.IntegerType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("monetary", T.DecimalType(22, 2)),
        T.StructField("R_score", T.IntegerType()),
        T.StructField("F_score", T.IntegerType()),
        T.StructField("M_score", T.IntegerType()),
        T.StructField("RFM_score", T.IntegerType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("segment", T.StringType()),
    ]
)

# Tier labels from the highest to the lowest mean spend.
TIERS = ["Champions", "Loyal Customers", "At Risk", "Lost / Inactive"]
HIGH_VALUE_TIERS = ["Champions", "Loyal Customers"]

# Age bands in display order.
AGE_BANDS = ["18-25", "26-35", "36-45", "46-55", "55+"]

# The stand-in for age bands when the source is the TPC-H-like star.
MARKET_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Maximum text length per column, as the relational schema declares it.
TEXT_LIMITS = {
    "customers": {"customer_id": 10, "gender": 10, "age_group": 10, "city": 50},
    "transactions": {"transaction_id": 10, "customer_id": 10, "category": 30, "payment_mode": 20},
}
