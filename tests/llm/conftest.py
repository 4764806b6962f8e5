import pytest
from pyspark.sql import SparkSession

from tillstone.operators.storage import WorkTables


@pytest.fixture
def tables(spark: SparkSession):
    made = WorkTables(spark)
    yield made
    made.drop()
