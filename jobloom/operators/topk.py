"""Top-k helpers.  ``row_number() <= k`` over a partitioned window lets Spark plan a
WindowGroupLimit before the shuffle, so each task ships at most k rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per(df: DataFrame, part_by: list[str], order_by: list, k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*part_by).orderBy(*order_by)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def _pick(df: DataFrame, key: list[str], order_by: list, fn) -> DataFrame:
    """One row per key chosen by ``fn`` (F.min / F.max) over struct(order columns, payload):
    structs compare field by field, so this is first/last by the order columns.  As an
    aggregate it is combined map-side, so a hot key never gathers its raw rows in one task."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    payload = [c for c in df.columns if c not in key]
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in payload])
    return df.groupBy(*key).agg(fn(packed).alias("_p")).select(*key, *[F.col("_p")[c].alias(c) for c in payload])


def last_wins(df: DataFrame, key: list[str], seq_col: str) -> DataFrame:
    """Keep the row with the greatest ``seq_col`` per key (dict overwrite semantics)."""
    return _pick(df, key, [seq_col], F.max)


def first_wins(df: DataFrame, key: list[str], order_by: list) -> DataFrame:
    """Keep the first row per key in ascending ``order_by`` order (ties: any)."""
    return _pick(df, key, order_by, F.min)
