"""A hand-made shop of nine customers."""

from __future__ import annotations

import datetime
from decimal import Decimal

from tillstone.plans.mart import Mart
from tillstone.schemas import CUSTOMERS, TRANSACTIONS

DAY = datetime.date

PEOPLE = [
    ("C1", "Female", "18-25", "Pune"),
    ("C2", "Male", "26-35", "Pune"),
    ("C3", "Female", "26-35", "Delhi"),
    ("C4", "Male", "36-45", "Delhi"),
    ("C5", "Male", "46-55", None),
    ("C6", "Female", "46-55", "Surat"),
    ("C7", "Male", "18-25", "Surat"),
    ("C8", None, "36-45", "Delhi"),
    ("C9", "Female", "26-35", "Pune"),  # never bought
]

# customer, day, category, net amount, payment mode, returned
SALES = [
    ("C1", DAY(2024, 1, 5), "Books", "100.00", "UPI", 0),
    ("C1", DAY(2024, 4, 30), "Toys", "50.01", "UPI", 1),
    ("C2", DAY(2024, 1, 20), "Books", "150.01", "Wallet", 0),
    ("C3", DAY(2024, 2, 1), "Books", "10.00", "UPI", 0),
    ("C4", DAY(2024, 2, 3), "Toys", "70.00", "UPI", 0),
    ("C4", DAY(2024, 2, 4), "Toys", "80.00", "UPI", 0),
    ("C4", DAY(2024, 4, 4), None, "5.00", None, 1),
    ("C5", DAY(2024, 2, 9), "Books", "900.00", "Card", 0),
    ("C6", DAY(2024, 1, 31), "Toys", "33.00", "Card", 0),
    ("C6", DAY(2024, 4, 1), "Toys", "33.00", "Card", 0),
    ("C7", DAY(2024, 4, 2), "Books", "12.50", "Card", 0),
    ("C8", DAY(2024, 4, 3), "Books", "700.00", "Card", 0),
    ("C8", DAY(2024, 1, 3), "Books", "1.00", "Card", 0),
    ("C8", DAY(2024, 1, 4), "Toys", "2.00", "Card", 0),
    ("X1", DAY(2024, 4, 20), "Books", "500.00", "Card", 0),  # unknown customer
]


def shop(spark, people=PEOPLE, sales=SALES, **options) -> Mart:
    options.setdefault("clustering_method", "lloyd")
    customers = [(*person, DAY(2021, 1, 1)) for person in people]
    transactions = [
        (f"T{i}", who, day, category, Decimal(amount), 1, 0, Decimal(amount), mode, returned)
        for i, (who, day, category, amount, mode, returned) in enumerate(sales)
    ]
    return Mart(
        spark,
        spark.createDataFrame(customers, CUSTOMERS),
        spark.createDataFrame(transactions, TRANSACTIONS),
        **options,
    )


def rows(table) -> list[tuple]:
    return [tuple(row) for row in table.collect()]
