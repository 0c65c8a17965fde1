"""Time-stamped tables kept by day: a time range reads the partitions of its days alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "_day"


def create(df: DataFrame, path: str, ts: str, mode: str = "errorifexists") -> None:
    """Write ``df`` with one folder a day, rows dealt by day so that a day is few files; a null time has
    its own folder.  ``mode`` "append" adds to the days."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # a day that holds most rows is dealt over several tasks
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    (df.withColumn(DAY, F.to_date(ts)).repartition(n, DAY, salt).write.mode(mode).partitionBy(DAY).parquet(path))


def time_range(spark: SparkSession, path: str, ts: str, lo: Column, hi: Column) -> DataFrame:
    """Rows with ``lo`` <= ts <= ``hi``; the days are pruned before any file is opened."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(DAY).between(F.to_date(lo), F.to_date(hi)) & F.col(ts).between(lo, hi)).drop(DAY)
