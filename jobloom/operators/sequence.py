"""Gap-free sequence numbers over a total order without a single-partition window.

``row_number() over (order by k)`` with no PARTITION BY moves every row into one
task.  Here the rows are range-partitioned on the order key into a fixed number
of partitions (an explicit count, so AQE keeps the partitioning as planned and
``spark_partition_id`` means the same thing on every read), sorted inside each
partition, and numbered as ``rows in earlier partitions + position in this
partition``.  The per-partition counts are one row per partition, so the
offsets shipped with the plan are bounded by the partition count, not by the data.
Requires a checkpoint directory (see :func:`jobloom.session.ensure_checkpoint_dir`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_sequence(df: DataFrame, order_by: list, name: str, start: int = 1,
                  num_partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``name`` = 1-based (or ``start``-based) position of each row in ``order_by``; with ``keep`` only these
    columns are written and stay."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = _num_partitions(df, num_partitions)
    # Range bounds are sampled from the input, whose row order inside shuffle blocks can
    # differ between evaluations; two evaluations could then disagree on which rows a
    # partition holds.  A reliable checkpoint (to spark.checkpoint.dir) fixes the
    # partitions once, so counts and numbering read the same data, and a lost executor
    # re-reads the files instead of re-sampling.
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    ranged = (ranged if keep is None else ranged.select(*keep)).checkpoint(eager=True)
    ranged = (ranged.withColumn("_seq_pid", F.spark_partition_id())
                    .withColumn("_seq_mid", F.monotonically_increasing_id()))
    # one count per partition (bounded by the partition count, not the data) -> offsets as a
    # literal array indexed by partition id; no window, no single-partition exchange
    counts = dict(ranged.groupBy("_seq_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid in range(n):
        offsets.append(run)
        run += counts.get(pid, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_seq_pid") + 1)
    # position inside the partition: monotonically_increasing_id = (pid << 33) + i
    local = F.col("_seq_mid") - F.shiftleft(F.col("_seq_pid").cast("long"), 33)
    return (ranged.withColumn(name, (off + local + F.lit(start)).cast("long"))
                  .drop("_seq_pid", "_seq_mid"))
