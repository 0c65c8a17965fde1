"""Keyed tables: updates by id that rewrite only the buckets they touch.

A table is written partitioned by a hash bucket of its key.  An update reads the buckets its keys
fall into, makes their new rows, and replaces these partitions alone by a dynamic partition
overwrite; the files of the others are not opened.  The new rows are checkpointed before the
overwrite, so that a task that is run again never reads a partition in replacement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int, mode: str) -> None:
    """One file a bucket: the rows are dealt by bucket before they are written."""
    (df.withColumn(BUCKET, _bucket(key, buckets)).repartition(buckets, BUCKET)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write ``df`` as a new keyed table."""
    _write(df, path, key, buckets, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _touched(df: DataFrame, key: str, buckets: int) -> list[int]:
    return [r[0] for r in df.select(_bucket(key, buckets)).distinct().collect()]      # ``buckets`` at most


def _rewrite(spark: SparkSession, path: str, key: str, buckets: int, touched: list[int], make: Callable[[DataFrame], DataFrame]) -> None:
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = make(old).select(*old.columns).checkpoint(eager=True)
    _write(new, path, key, buckets, "overwrite")
    # a bucket that has lost its last row is in no partition of the new rows
    left = set(_touched(new, key, buckets))
    for b in set(touched) - left:
        _empty(spark, old, f"{path}/{BUCKET}={b}")


def _empty(spark: SparkSession, like: DataFrame, path: str) -> None:
    spark.createDataFrame([], like.schema).write.mode("overwrite").parquet(path)


def update(spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Set the columns of ``changes`` (unique in ``key``) where they are not null; rows and columns that no
    change names keep their values.  A change without a row is left out, as by an update of a missing id."""
    columns = [c for c in changes.columns if c != key]

    def make(old: DataFrame) -> DataFrame:
        new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
        return old.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns})

    _rewrite(spark, path, key, buckets, _touched(changes, key, buckets), make)


def replace_by_owner(spark: SparkSession, path: str, owners: DataFrame, rows: DataFrame, owner: str, buckets: int = BUCKETS) -> None:
    """The rows of all ``owners`` become those of ``rows``; an owner without one ends with none.  The
    table is keyed by ``owner``; rows of other owners are kept."""
    owners = owners.select(owner).distinct()

    def make(old: DataFrame) -> DataFrame:
        return old.join(owners, owner, "left_anti").unionByName(rows.join(owners, owner, "left_semi").select(*old.columns))

    _rewrite(spark, path, owner, buckets, _touched(owners, owner, buckets), make)


def create_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` at ``path`` (a table ``name`` over these files) and return it."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def lookup(bucketed: DataFrame, keys: DataFrame, key: str, found: str = "is_found") -> DataFrame:
    """One row for each distinct key of ``keys`` and row of ``bucketed`` with it, and one with ``found`` false
    for each key without a row.  Both sides bucketed alike join without an exchange."""
    return keys.select(key).distinct().join(bucketed.withColumn(found, F.lit(True)), key, "left").withColumn(found, F.coalesce(found, F.lit(False)))
