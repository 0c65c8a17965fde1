"""Helpers of the corpus operators: table access, shared folders, UTF-8 word splitting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import table

__all__ = ["table", "WORD", "saved", "emptied", "map_rows", "text_rows", "text_key", "sample_ids", "checked_broadcast"]

BROADCAST_ROWS = 100_000

# a word is a run of characters that are neither a blank nor one of the five ASCII controls
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def saved(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the lineage is
    cut, and every executor (also a replacement of a lost one) can read the files."""
    path = shared_dir(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Give back the disk of a ``saved`` table that is read no more: an empty one takes its place."""
    spark = df.sparkSession
    path = df.inputFiles()
    if path:
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path[0].rsplit("/", 1)[0])


def text_rows(docs: DataFrame, *extra: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key, the text and the named columns; other columns, whatever their names, stay out."""
    return docs.select(key, text, *extra)


def text_key(text: str = "text"):
    """128 bits that stand for a whole text (null has its own value)."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list], Iterator[tuple] | list]],
             chunk_bytes: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` over whole rows.

    ``make()`` runs once in each task and returns a function from a list of row tuples to
    output tuples.  Rows are handed over in chunks of at most ``chunk_bytes`` of Arrow data
    (one row at least), so very long texts do not pile up in a Python worker.
    """
    names = [c.strip().split(" ")[0] for c in _columns(schema)]

    def run(batches):
        fn = make()
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(n, int(n * chunk_bytes / max(1, batch.nbytes))))
            for at in range(0, n, step):
                part = batch.slice(at, step)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                out = list(fn(rows))
                for b in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, type=t) for col, t in zip(zip(*out[b:b + 5000]), types)], names=names)

    types = _arrow_types(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def _columns(schema: str) -> list[str]:
    depth, cur, out = 0, "", []
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]


def sample_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, the same ones for the same labels, chosen by a hash of
    the id.  The bound makes the result safe to broadcast and to fit a classifier on."""
    return labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a saved table of narrow rows) with a broadcast hint if it has at most ``rows`` rows;
    beyond that it is joined by a shuffle, with the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
