"""Folding blocks of one table into the rows of another.

The rows stay where they are and carry a state; the other table is dealt by hash into blocks of a
bounded size, which are collected and sent to the rows one after another.  So what the two sides
have in common is counted and ranked without a row for each pair, and nothing but the blocks moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

BLOCK_SIZE = 4_000_000          # array entries of one block: some 50 MB in a task


def fold(rows: DataFrame, blocks: DataFrame, size: str, make: Callable[[pa.Table], object], step: Callable, state: dict[str, str],
         start: dict, block_size: int = BLOCK_SIZE, whole: bool = False) -> DataFrame:
    """``rows`` with the columns ``state`` after ``step(block, *row, *state) -> new state`` for every block; if ``whole``,
    after ``step(block, batch) -> Arrow arrays of the new state`` for whole Arrow batches of rows.

    ``blocks`` has a long ``_key`` (a hash that spreads its rows) and ``size`` (the entries of a row); a block holds
    about ``block_size`` entries, and ``make`` turns its Arrow table into what ``step`` reads.  With more
    than one block, ``blocks`` is written by block and the rows are written after each step, so the driver
    holds one block at a time and a lost executor starts from the last one."""
    spark = rows.sparkSession
    base = shared_dir(spark, f"fold-{uuid.uuid4().hex}")
    n = -(-int(blocks.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // block_size)
    given = rows.columns
    rows = rows.select(*given, *[F.lit(start[c]).cast(t).alias(c) for c, t in state.items()])
    schema = rows.schema
    if n > 1:
        blocks.withColumn("_block", F.pmod("_key", F.lit(n))).write.partitionBy("_block").parquet(f"{base}/blocks")
        blocks = spark.read.parquet(f"{base}/blocks")
    for b in range(n):
        block = make((blocks.where(F.col("_block") == b).drop("_block") if n > 1 else blocks).toArrow())

        def run(batches, block=block):
            for batch in batches:
                if whole:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:len(given)], *step(block, batch)], schema=batch.schema)
                    continue
                columns = [c.to_pylist() for c in batch.columns]
                new = [step(block, *row) for row in zip(*columns)]
                fields = list(batch.schema)[len(given):]
                changed = [pa.array(c, f.type) for c, f in zip(zip(*new), fields)] if new else batch.columns[len(given):]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(given)], *changed], schema=batch.schema)

        rows = rows.mapInArrow(run, schema)
        if b < n - 1:
            rows.write.parquet(f"{base}/rows-{b}")
            rows = spark.read.schema(schema).parquet(f"{base}/rows-{b}")
    return rows


class Postings:
    """For each value, the owners that hold it (and how often): ``values`` is a list array, one row an owner."""

    def __init__(self, values: pa.ListArray):
        n = np.diff(values.offsets.to_numpy())
        owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
        self.n_owners = len(n)
        self.values, held = np.unique(values.flatten().to_numpy(), return_inverse=True)
        pairs, self._times = np.unique(held * max(1, len(n)) + owner, return_counts=True)
        held, self._owners = np.divmod(pairs, max(1, len(n)))
        self._ends = np.searchsorted(held, np.arange(len(self.values)), "right")

    def count(self, values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(owner, count) of the owners that hold some of the distinct ``values``; a value counts as often as
        the owner holds it, ``times`` as often if given."""
        at = np.searchsorted(self.values, values)
        known = at < len(self.values)
        known[known] = self.values[at[known]] == values[known]
        own = at[known]
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = [slice(self._ends[v - 1] if v else 0, self._ends[v]) for v in own]
        owners = np.concatenate([self._owners[x] for x in lists])
        weights = np.concatenate([self._times[x] for x in lists])
        if times is not None:
            weights = weights * np.repeat(times[known], [x.stop - x.start for x in lists])
        if len(owners) < self.n_owners // 8:
            found, of = np.unique(owners, return_inverse=True)
            return found, np.bincount(of, weights).astype(np.int64)
        total = np.bincount(owners, weights, self.n_owners).astype(np.int64)
        found = np.flatnonzero(total)
        return found, total[found]
