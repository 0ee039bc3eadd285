"""Session settings that the reports need."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Shuffles start with this many partitions at least: up to 200 Spark's map tasks write without sorting in memory.
SHUFFLE_PARTITIONS = 200
# Adaptive execution puts partitions together up to this size, compressed; joins and groups of labels take some 50 times as much in memory.
TASK_SHUFFLE = "8m"
# Beyond 200 of them, there is a partition for every 4 MB of the largest table as stored.
PARTITION_INPUT = 4 << 20
# Map tasks that write to more than 200 partitions sort all they read in memory, some six times its size as stored.
TASK_INPUT = 16 << 20


def largest_table(spark: SparkSession, folder: str) -> int:
    """Bytes of the largest table, a file or a folder, in a folder of tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((files.getContentSummary(s.getPath()).getLength() for s in files.listStatus(path)), default=0)


def partitions(spark: SparkSession, input_bytes: int = 0) -> int:
    """Partitions a shuffle of much data starts with; a session with more shuffle partitions keeps them."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(SHUFFLE_PARTITIONS, own, -(-input_bytes // PARTITION_INPUT))


def scan_bytes(spark: SparkSession) -> int:
    """Most bytes of a file that a task reads; a session with smaller tasks keeps them."""
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return min(TASK_INPUT, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own))


def bound_tasks(spark: SparkSession, folder: str) -> None:
    """Let the number of tasks before and after a shuffle of the tables in ``folder`` grow with them instead of the memory of each."""
    initial = partitions(spark, largest_table(spark, folder))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(scan_bytes(spark)))
