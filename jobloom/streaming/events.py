"""Structured Streaming jobs over an append-only file source.

* ``ingest_first_seen``: insert-if-absent by key; each micro-batch keeps its first row
  per key and anti-joins the key buckets of the target before it writes its own folder, so
  a replayed batch (after a failure, same checkpoint) inserts nothing twice.
* ``dedup_within_watermark``: bounded-state de-duplication (any row of a key).
* ``first_of_sessions``: bounded-state de-duplication by session windows; the earliest row of a key wins.
* ``recent``: stateless look-back filter on event time.

Sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topk import first_wins


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of one table, a folder of part files or a single file; event time
    is cast to a UTC ``timestamp``.  A path without a readable file fails when the schema is read."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    stored = spark.read.parquet(path)
    r = spark.readStream.schema(stored.schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if _is_single_file(stored, f"{table}.parquet"):     # the source watches folders: take the one file out of its folder
        s = r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    else:
        s = r.parquet(path)
    if "ts" in s.columns:
        s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    return s


def _is_single_file(stored: DataFrame, name: str) -> bool:
    first = stored.select("_metadata.file_name").first()
    return first is not None and first[0] == name


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one if nothing was written there; other errors (schema,
    permission) are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


KEY_BUCKETS = 64


def ingest_first_seen(stream: DataFrame, keys: list[str], order_by: list[str], target: str,
                      checkpoint: str):
    """Start the insert-if-absent stream; returns the StreamingQuery.

    The target is partitioned by a hash bucket of the key, and a micro-batch reads only the
    buckets its keys fall into.  Each batch writes its own folder (``batch=n``) in overwrite
    mode, so a replayed batch replaces what its first, failed run wrote.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = first_wins(batch, keys, [F.col(c) for c in order_by]).withColumn(
            "bucket", F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int"))
        schema = first.drop("bucket").schema.add("batch", "long").add("bucket", "integer")
        buckets = [r.bucket for r in first.select("bucket").distinct().collect()]        # KEY_BUCKETS at most
        existing = (read_or_empty(spark, target, schema)
                    .where(F.col("bucket").isin(buckets) & (F.col("batch") != batch_id)).select(*keys).distinct())
        # one file a bucket and batch, however many tasks the batch has
        (first.join(existing, keys, "left_anti").repartition(len(buckets) or 1, "bucket").write.mode("overwrite").partitionBy("bucket")
              .parquet(f"{target}/batch={batch_id}"))

    return (stream.writeStream.foreachBatch(upsert)
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def first_of_sessions(stream: DataFrame, keys: list[str], order_by: list[str], gap: str, delay: str, target: str, checkpoint: str):
    """The first event of each session of a key, by ``order_by`` (event time first): a session ends ``gap`` after
    its last event.  A session's first event is kept in state and written, whole, once the watermark has passed
    the session's end, so the earliest event wins whatever the order of arrival within ``delay``."""
    rest = [c for c in stream.columns if c not in keys]
    first = (stream.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("session"))
             .agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("first"), F.count(F.lit(1)).alias("n_events")))
    out = first.select(*keys, F.col("session.end").alias("session_end"), "n_events", *[F.col("first")[c].alias(c) for c in rest])
    return (out.writeStream.format("parquet").option("path", target)
               .option("checkpointLocation", checkpoint).outputMode("append")
               .trigger(availableNow=True).start())


def dedup_within_watermark(stream: DataFrame, keys: list[str], delay: str, target: str, checkpoint: str):
    d = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return (d.writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())


def recent(stream: DataFrame, as_of: str, days: int, target: str, checkpoint: str):
    lo = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    r = stream.where(F.col("ts") >= lo)
    return (r.writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())


def run_to_end(query, timeout_s: int = 3600) -> None:
    query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError("stream did not drain its input in time")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
