"""Size estimates and the number of shuffle partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BYTES_PER_PARTITION = 256 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

#: Catalyst's estimate for a table whose size it cannot know is as large as a number can be.
UNKNOWN = 1 << 60

#: More partitions than this are never asked for: the driver keeps books on each. At 256 MB they hold 256 TB.
MOST_PARTITIONS = 1 << 20

#: Numbers set here, by application: a larger input may raise them, a number set by the user stays.
_set_here: dict[str, str] = {}


def planned_bytes(table: DataFrame) -> int:
    """Catalyst's size estimate; for a scan the bytes of its files, scaled to the columns read."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned_bytes(table: DataFrame) -> int:
    """Bytes of all inputs that a table reads, each input once per scan.

    The estimate for a join without statistics is the product of its sides, so only the leaves of the plan count.
    Inputs whose size Catalyst cannot know count as nothing.
    """
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(at).stats().sizeInBytes())) for at in range(leaves.size())]
    return sum(size for size in sizes if size < UNKNOWN)


def fits_broadcast(table: DataFrame) -> bool:
    """Whether Catalyst's size estimate lets it broadcast the table on its own."""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(table) <= int(limit)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle starts with."""
    return int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def size_shuffles(table: DataFrame) -> None:
    """Let shuffles of a large input start with partitions of about ``BYTES_PER_PARTITION`` of what is scanned.

    Only the starting number of adaptive execution is raised, and only above what the session asks for:
    it still merges the partitions of small shuffles. A number set by the user is kept, one set here for a
    smaller input is raised. Inputs of less than one such partition never touch the session.
    """
    spark = table.sparkSession
    wanted = min(scanned_bytes(table) // BYTES_PER_PARTITION, MOST_PARTITIONS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled") == "true"
    application, now = spark.sparkContext.applicationId, spark.conf.get(INITIAL, None)
    if adaptive and now in (None, _set_here.get(application)) and wanted > shuffle_partitions(spark):
        _set_here[application] = str(wanted)
        spark.conf.set(INITIAL, str(wanted))
