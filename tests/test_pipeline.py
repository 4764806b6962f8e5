"""CSV in, reports out; catalog tables, views and SQL."""

import glob
import threading

import pytest
from pyspark.sql import functions as F
from shop import SALES, rows, shop

from tillstone.plans import rfm, sales
from tillstone.plans.mart import Mart
from tillstone.plans.pipeline import BrokenKeysError, publish, run
from tillstone.plans.views import register_views, run_sql
from tillstone.schemas import TRANSACTIONS
from tillstone.sources.files import preview_csv, publish_table, write_bundle


@pytest.fixture(scope="module")
def csv_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    source = shop(spark, sales=SALES[:-1])
    write_bundle({"customers.csv": source._customers, "transactions.csv": source._transactions}, folder, "csv")
    return folder


def test_csv_round_trip(spark, csv_folder):
    mart = Mart.from_csv(spark, csv_folder)
    direct = shop(spark, sales=SALES[:-1])
    assert mart.transactions.schema == direct.transactions.schema
    assert sorted(rows(mart.transactions)) == sorted(rows(direct.transactions))


def test_bad_csv_value_fails(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,gender,age_group,city,signup_date\nC1,Male,18-25,Pune,soon\n")
    (tmp_path / "transactions.csv").write_text(",".join(TRANSACTIONS.names) + "\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        Mart.from_csv(spark, str(tmp_path)).customers


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_run_writes_every_report(spark, csv_folder, tmp_path, fmt):
    mart = Mart.from_csv(spark, csv_folder, clustering_method={"csv": "lloyd", "parquet": "kmeans"}[fmt])
    paths = run(mart, str(tmp_path), fmt)
    assert len(paths) == 11 + 9 + 9 + 8 + 4 + 4 + 11 + 2
    assert all(glob.glob(f"{path}/part-*") for path in paths.values())
    read = spark.read.parquet if fmt == "parquet" else lambda path: spark.read.csv(path, header=True)
    assert read(paths["Transactions"]).count() == len(SALES) - 1
    assert spark.read.csv(paths["rfm_segments"], header=True).count() == 8


def test_run_stops_on_orphans(spark, tmp_path):
    with pytest.raises(BrokenKeysError, match="transactions"):
        run(shop(spark), str(tmp_path))


def test_views_and_sql(spark):
    mart = shop(spark)
    names = register_views(mart)
    assert len(names) == 11
    assert spark.sql("select count(*) from vw_segment_x_category").first()[0] > 0
    text = "select customer_id, sum(final_amount) as spent from transactions where category = :category group by 1"
    best = run_sql(mart, text, category="Books").orderBy(F.desc("spent")).first()
    assert best["customer_id"] == "C5"
    join = """
        select c.city, count(distinct t.customer_id) as n
        from transactions t join customers c on t.customer_id = c.customer_id
        group by c.city order by n desc, c.city"""
    assert rows(run_sql(mart, join))[0] == ("Delhi", 3)


def test_catalog_tables(spark, tmp_path):
    mart = shop(spark)
    spark.sql(f"create database if not exists till location '{tmp_path}/till.db'")
    publish(mart, "till")
    publish(mart, "till")  # replaces the tables
    assert spark.table("till.transactions").count() == len(SALES)
    spark.sql("drop database till cascade")


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"create database counter location '{tmp_path}/counter.db'")
    yield "counter"
    spark.sql("drop database counter cascade")


def test_a_failed_write_leaves_the_published_version(spark, database):
    publish_table(spark.range(5), database, "numbers")
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish_table(broken, database, "numbers")
    assert spark.table("counter.numbers").count() == 5
    publish_table(spark.range(3).withColumn("more", F.lit("x")), database, "numbers")  # other columns
    assert spark.table("counter.numbers").columns == ["id", "more"]
    # a version that was never published does not outlive the next one
    publish_table(spark.range(4), database, "numbers")
    assert spark.table("counter.numbers").count() == 4


def test_readers_see_whole_versions_during_the_swap(spark, database, tmp_path):
    sizes = [10, 200, 30, 400]
    publish_table(spark.range(sizes[0]), database, "numbers")
    begun = spark.table("counter.numbers")
    seen, errors, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.table("counter.numbers").count())
            except Exception as error:
                errors.append(error)

    readers = [threading.Thread(target=read) for _ in range(3)]
    for reader in readers:
        reader.start()
    publish_table(spark.range(sizes[1]), database, "numbers")
    assert begun.count() == sizes[0]  # planned before the swap, read after it
    for size in sizes[2:]:
        publish_table(spark.range(size), database, "numbers")
    stop.set()
    for reader in readers:
        reader.join()
    assert not errors and seen <= set(sizes)
    assert len(glob.glob(f"{tmp_path}/counter.db/numbers-versions/*")) == 2


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_id,city,gender,age_group,signup_date\nC1,Pune,Male,18-25,2021-01-01\nC2,Pune,Male,18-25,soon\nC3,Pune\n"
    )
    good = "T1,C1,2024-01-02,Books,10.00,2,0,20.00,UPI,0"
    lines = [good, "T2,C1,2024-13-02,Books,10.00,2,0,20.00,UPI,0", "T3,C1,2024-01-02,Books,ten,2,0,20.00,UPI,0",
             "T4,C1,2024-01-02,Books,10.00,2,0,99999999999.00,UPI,0", "T5,C1,2024-01-02,Books,10.00,2,0,20.00,UPI,0,more",
             'T6,C1,,"Books, old",,,,,,']
    (tmp_path / "transactions.csv").write_text("\n".join([",".join(TRANSACTIONS.names), *lines]) + "\n")
    mart = Mart.from_csv(spark, str(tmp_path), on_bad_rows="quarantine", clustering_method="lloyd")
    assert rows(mart.customers.select("customer_id", "city")) == [("C1", "Pune")]
    assert sorted(rows(mart.transactions.select("transaction_id", "category"))) == [("T1", "Books"), ("T6", "Books, old")]
    rejected = {row["line"].split(",")[0]: (row["table_name"], row["reason"]) for row in mart.rejected.collect()}
    assert rejected == {
        "C2": ("customers", "signup_date is no date"),
        "C3": ("customers", "not the 5 fields of the header"),
        "T2": ("transactions", "transaction_date is no date"),
        "T3": ("transactions", "product_amount is no decimal(12,2)"),
        "T4": ("transactions", "final_amount is no decimal(12,2)"),
        "T5": ("transactions", "not the 10 fields of the header"),
    }
    assert {row["file"].rpartition("/")[2] for row in mart.rejected.collect()} == {"customers.csv", "transactions.csv"}
    mart.close()


def test_stored_segments_are_reported_as_they_are(spark, tmp_path):
    mart = shop(spark, sales=SALES[:-1])
    mart._customers.write.parquet(f"{tmp_path}/customers.parquet")
    mart._transactions.write.parquet(f"{tmp_path}/transactions.parquet")
    low = F.col("customer_id") == "C5"
    other = mart.rfm_segments.withColumns(
        {"segment": F.when(low, "At Risk").otherwise("Champions"), "cluster": F.when(low, 2).otherwise(0)}
    )
    other.write.parquet(f"{tmp_path}/rfm_segments.parquet")
    again = Mart.from_parquet(spark, str(tmp_path))
    assert sorted(rows(rfm.segment_distribution(again).select("segment", "n"))) == [("At Risk", 1), ("Champions", 7)]
    assert sorted(rows(again.rfm_segments)) == sorted(rows(other.select(*again.rfm_segments.columns)))
    assert sales.segment_contribution(again).count() == 2 and rfm.silhouette_by_cluster(again).count() == 2


def test_close_deletes_the_work_tables(spark):
    mart = shop(spark)
    assert mart.profiles.count() == 10
    folder = mart.store.folder
    assert glob.glob(f"{folder}/profiles-*")
    mart.close()
    assert not glob.glob(folder)


def test_preview(spark, csv_folder):
    assert preview_csv(spark, f"{csv_folder}/customers.csv", 3).count() == 3


def test_reports_write_no_details_of_transactions(spark):
    mart = Mart.from_star(spark, "/root/testdata/sf0.001", clustering_method="lloyd")
    written = spark.read.parquet(mart.facts.inputFiles()[0].rpartition("/")[0])
    assert not {"transaction_id", "product_amount", "quantity"} & set(written.columns)
    whole = Mart.from_star(spark, "/root/testdata/sf0.001", clustering_method="lloyd")
    assert whole.transactions.count() == 6000
    # the detailed table is there, so nothing is joined or written again
    assert sorted(whole.facts.inputFiles()) == sorted(whole.transactions.inputFiles())
    assert whole.facts.exceptAll(mart.facts.select(whole.facts.columns)).isEmpty() and mart.facts.count() == 6000
    mart.close()
    whole.close()


def test_parsed_lines_are_written_once(spark, csv_folder):
    mart = Mart.from_csv(spark, str(csv_folder), on_bad_rows="quarantine", clustering_method="lloyd")
    plain = Mart.from_csv(spark, str(csv_folder), clustering_method="lloyd")
    for name in ("customers", "facts", "transactions"):
        mine, theirs = getattr(mart, name), getattr(plain, name)
        assert all(mart.parsed.folder.rpartition("/")[2] in path for path in mine.inputFiles()), name
        assert mine.columns == theirs.columns and mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
    mart.close()
    plain.close()
