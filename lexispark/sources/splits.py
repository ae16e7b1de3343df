"""How a scan's rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, dealt evenly over the cores if the scan gives rows to fewer tasks than there are cores, as a file of few row groups does.

    Rows by partition are counted without reading columns, once a path and session, and only where the scan has few partitions; other
    tables are read as they are. Columns and filters still reach the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() > 4 * cores:
        return df
    known = spark.__dict__.setdefault("_lexispark_splits", {})
    if path not in known:
        known[path] = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 0").count()
    return df if known[path] >= cores or known[path] == 0 else df.repartition(cores)
