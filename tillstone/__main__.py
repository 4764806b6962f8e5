"""Run the whole batch: ``python -m tillstone FOLDER OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tillstone.plans.mart import METHODS, Mart
from tillstone.plans.pipeline import run

if __name__ == "__main__":
    parser = argparse.ArgumentParser(prog="tillstone")
    parser.add_argument("folder", help="folder with customers and transactions as CSV or Parquet, or with star tables")
    parser.add_argument("out", help="folder for the reports")
    parser.add_argument("--source", choices=["csv", "parquet", "star"], default="csv")
    parser.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--clustering", choices=METHODS, default="kmeans")
    parser.add_argument("--duplicate-edges", choices=["error", "merge"], default="error")
    parser.add_argument("--bad-rows", choices=["fail", "quarantine"], default="fail", help="of CSV files")
    parser.add_argument("--no-strict", action="store_true", help="go on if keys are broken")
    options = parser.parse_args()
    session = SparkSession.builder.appName("tillstone").getOrCreate()
    build = {"csv": Mart.from_csv, "parquet": Mart.from_parquet, "star": Mart.from_star}[options.source]
    mart = build(
        session,
        options.folder,
        clustering_method=options.clustering,
        on_duplicate_edges=options.duplicate_edges,
        **({"on_bad_rows": options.bad_rows} if options.source == "csv" else {}),
    )
    try:
        for name, path in run(mart, options.out, options.format, strict=not options.no_strict).items():
            print(f"{name}\t{path}")
    finally:
        mart.close()
        session.stop()
