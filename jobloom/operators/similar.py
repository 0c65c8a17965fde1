"""Best items of many query vectors by inner product, exact.

The items are range-partitioned and sorted by descending norm.  By Cauchy and Schwarz no item scores
more than the product of the two norms, so a partition is left at the first tile whose largest norm
cannot reach the k-th score of any query.  A first pass over the longest items gives every query a
k-th score to start from.  Queries are taken in blocks of ``QUERIES``, collected one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import top_k_per

QUERIES, TILE, HEAD = 1024, 1024, 8192
SLACK = 1e-6                 # sums in another order differ in the last places


def by_norm(items: DataFrame, id_col: str, vec_col: str, num_partitions: int | None = None) -> DataFrame:
    """(id, vec, norm), partitioned and sorted by descending norm, written once; null vectors stay out."""
    n = num_partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = items.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).withColumn("norm", norm)
    order = F.col("norm").desc()
    return rows.repartitionByRange(n, order).sortWithinPartitions(order, "id").checkpoint(eager=True)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors are padded with zeros, longer ones cut."""
    size = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(size), width)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width))
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def _best(items: DataFrame, vectors: np.ndarray, floor: np.ndarray, k: int, digits: int) -> DataFrame:
    """(q, id, score): the first ``k`` items of each query among those that reach its ``floor``, and how many
    tiles were multiplied (q = -1, in ``id``)."""
    norms = np.sqrt((vectors * vectors).sum(1))

    def run(batches):
        q, ids, score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        kth, read = floor.copy(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                # the rows come by descending norm: what one tile cannot reach the next ones cannot either
                open_ = np.flatnonzero(norms * part.column(2)[0].as_py() >= kth - SLACK)
                if not len(open_):
                    break
                read += 1
                s = np.round(vectors[open_] @ _matrix(part.column(1), vectors.shape[1]).T, digits)
                i, j = np.nonzero(s >= kth[open_][:, None])
                q, ids, score = (np.concatenate(x) for x in ((q, open_[i]), (ids, part.column(0).to_numpy()[j]), (score, s[i, j])))
                order = np.lexsort((ids, -score, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                last = order[place == k - 1]
                kth[q[last]] = np.maximum(kth[q[last]], score[last])
                q, ids, score = (x[order[place < k]] for x in (q, ids, score))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(q, -1)), pa.array(np.append(ids, read)), pa.array(np.append(score, 0.0))],
                                         names=["q", "id", "score"])

    return items.select("id", "vec", "norm").mapInArrow(run, "q bigint, id bigint, score double")


def top_similar(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, block: int = QUERIES, head: int = HEAD) -> DataFrame:
    """(query_id, id, score, rank): for each row (id, vec) of ``queries`` its first ``k`` of ``by_norm`` items by
    the score rounded to ``digits``, then id; an item with the query's own id takes no part."""
    spark = items.sparkSession
    queries = queries.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    queries = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block))))).checkpoint(eager=True)
    longest = items.orderBy(F.col("norm").desc(), "id").limit(head).checkpoint(eager=True).coalesce(1).sortWithinPartitions(F.col("norm").desc())
    out = None
    for b in sorted(r[0] for r in queries.select("_b").distinct().collect()):
        rows = queries.where(F.col("_b") == b).select("id", "vec").toArrow()
        ids = rows.column("id").to_numpy()
        vec = rows.column("vec").combine_chunks()
        vectors = _matrix(vec, max(1, int(np.diff(vec.offsets.to_numpy()).max(initial=0))))
        # one more than k: the query's own row may be among them
        first = _best(longest, vectors, np.full(len(ids), -np.inf), k + 1, digits).where("q >= 0").toArrow()
        q, s = first.column("q").to_numpy(), first.column("score").to_numpy()
        floor = np.full(len(ids), -np.inf)
        full = np.bincount(q, minlength=len(ids)) == k + 1
        least = np.full(len(ids), np.inf)
        np.minimum.at(least, q, s)
        floor[full] = least[full]
        known = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids))), "query_id": pa.array(ids)}))
        found = _best(items, vectors, floor, k + 1, digits).where("q >= 0").join(F.broadcast(known), "q")      # ``block`` rows at most
        found = top_k_per(found.where("id <> query_id").drop("q"), ["query_id"], [F.col("score").desc(), F.col("id")], k).checkpoint(eager=True)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    return out.select("query_id", "id", "score", "rank")
