"""Explicit hash partitioning for co-located pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *cols: str, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` on ``cols`` into an explicit number of partitions.

    The pair-generating joins downstream turn a small keyed input into many rows; with a
    partition count left open, AQE would coalesce the small input into very few tasks and
    serialise that expansion.  An explicit count (default: spark.sql.shuffle.partitions)
    is kept as planned, and later aggregates / windows on the same keys reuse it.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *cols)



def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Deal the rows of ``df`` anew for costly work on each of them, as many partitions as ``spread`` makes.

    Where ``df`` is partitioned on ``cols`` already, as after a join, ``spread`` is planned away and AQE
    coalesces the join's small output into few tasks; a hash of ``cols`` is a partitioning of its own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, F.xxhash64(*cols))
