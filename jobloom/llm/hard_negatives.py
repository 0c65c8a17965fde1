"""Hard-negative mining by Strassen multiplication of integer tiles.

Anchors are taken in blocks of ``ANCHORS`` rows; a block meets every row, in tiles, in two passes.
A tile's scores are the product of its anchors' and its rows' components by Strassen's recursion
over 64-bit integers, padded with zeros to even sides, so that all additions are exact.  The first
pass multiplies rows of one label and keeps for each anchor a heap of its best rows; the second
keeps for each anchor and positive a heap of the best rows of other labels whose score lies in
the positive's window.  Heaps are bounded; those of all tasks are merged by (score, vec_id), and a
block's result is written before the next block starts.  The driver holds one block of anchors
and their positives.

Defined cases: rows with a null label or vector, or any null or non-finite component, take no
part; a null vec_id is no anchor and comes last among equal scores; ties go to the smaller vec_id;
repeated rows are rows of their own, as anchors, positives and negatives, and "other" leaves out
one row, the anchor's own; vectors of different lengths are padded with zeros; whole-number
components beyond what keeps every score within 64 bits (2^26 for up to 128 components) are taken
as that bound; an empty table or one without anchors gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_sequence
from ..operators.topk import top_k_per
from ..session import shared_dir
from .common import saved

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100       # LOW * positive <= WHOLE * negative <= HIGH * positive
SCALE = 256
ANCHORS = 8192                       # rows of a block
TILE = 512                           # sides of a tile at most
LEAF = 32                            # sides up to which a product is formed directly
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices.  Sums wrap around in 64 bits, which is exact for every
    entry that fits into 64 bits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def whole_components(vectors: pa.ListArray | pa.ChunkedArray, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, one row a vector, cut or padded with zeros to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    bound = float(1 << 26 - max(0, (width - 1).bit_length() - 6) // 2)
    out = np.zeros((len(size), width), np.int64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * values), -bound, bound).astype(np.int64)
    out[row[at < width], at[at < width]] = whole[at < width]
    return out


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` slots; null ids come last among equal scores."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.worst = np.full(n, LEAST)               # a slot's k-th score; LEAST while it has fewer
        self._rows = [np.zeros(0, np.int64)] * 4     # slot, score, id, 1 for a null id

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids, null = (np.concatenate(x) for x in zip(self._rows, (slot, score, ids, null)))
        order = np.lexsort((ids, null, -score, slot))
        place = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        last = order[place == self.k - 1]
        self.worst[slot[last]] = score[last]
        self._rows = [x[order[place < self.k]] for x in (slot, score, ids, null)]

    def rows(self) -> list[np.ndarray]:
        return self._rows


class Block:
    """Anchors of one block: ids, labels and whole-number components."""

    def __init__(self, rows: pa.Table, scale: int = SCALE):
        vectors = rows.column("vector")
        self.width = max(1, *(len(v) for v in vectors.to_pylist())) if len(rows) else 1
        self.scale = scale
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.parts = whole_components(vectors, self.width, scale)
        self.own = (self.parts * self.parts).sum(1)

    def tiles(self, batch: pa.RecordBatch):
        """(ids, null, labels, components by column) of the rows of a batch, ``TILE`` at a time."""
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            ids = part.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            yield (ids.fill_null(0).to_numpy(zero_copy_only=False), null, part.column(1).to_numpy(zero_copy_only=False),
                   whole_components(part.column(2), self.width, self.scale).T)


def _emit(columns: list[np.ndarray], null: np.ndarray, names: list[str], step: int = 10_000):
    arrays = [pa.array(c) for c in columns]
    arrays[-1] = pa.array(columns[-1], mask=null.astype(bool))
    table = pa.Table.from_arrays(arrays, names=names)
    yield from table.to_batches(max_chunksize=step)


def _best_of_label(items: DataFrame, block: Block, k: int) -> DataFrame:
    """(anchor, score, id): for each anchor of the block the first ``k`` rows of its label, its own included."""
    groups = [(label, np.flatnonzero(block.labels == label)) for label in np.unique(block.labels)]

    def run(batches):
        heaps = Heaps(len(block.ids), k)
        for batch in batches:
            for ids, null, labels, parts in block.tiles(batch):
                for label, anchors in groups:
                    columns = np.flatnonzero(labels == label)
                    if not len(columns):
                        continue
                    right = np.ascontiguousarray(parts[:, columns])
                    for a in range(0, len(anchors), TILE):
                        rows = anchors[a:a + TILE]
                        score = strassen(block.parts[rows], right)
                        i, j = np.nonzero(score >= heaps.worst[rows][:, None])
                        heaps.offer(rows[i], score[i, j], ids[columns[j]], null[columns[j]])
        slot, score, ids, null = heaps.rows()
        yield from _emit([slot, score, ids], null, ["anchor", "score", "id"])

    rows = items.mapInArrow(run, "anchor bigint, score bigint, id bigint")
    return top_k_per(rows, ["anchor"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k, "place")


def _positives(found: pa.Table, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, 1 for a null id, score) of each anchor's first ``k`` other rows."""
    anchor, place, score = (found.column(c).to_numpy() for c in ("anchor", "place", "score"))
    null = found.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = found.column("id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((place, anchor))
    anchor, score, ids, null = anchor[order], score[order], ids[order], null[order]
    own = (ids == block.ids[anchor]) & (null == 0) & (score == block.own[anchor])
    at = np.flatnonzero(own)
    keep = np.ones(len(anchor), bool)
    keep[at[np.unique(anchor[at], return_index=True)[1]]] = False
    anchor, score, ids, null = anchor[keep], score[keep], ids[keep], null[keep]
    first = np.arange(len(anchor)) - np.searchsorted(anchor, anchor) < k
    return anchor[first], ids[first], null[first], score[first]


def _best_in_windows(items: DataFrame, block: Block, positives: tuple, k: int, low: int, high: int, whole: int) -> DataFrame:
    """The first ``k`` rows of other labels within each positive's window."""
    anchor, pos_ids, pos_null, pos_score = positives
    least, most = -((-low * pos_score) // whole), (high * pos_score) // whole
    depth = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    by_anchor = np.full((int(depth.max()) + 1 if len(depth) else 0, len(block.ids)), -1)
    by_anchor[depth, anchor] = np.arange(len(anchor))

    def run(batches):
        heaps = Heaps(len(anchor), k)
        for batch in batches:
            for ids, null, labels, parts in block.tiles(batch):
                for a in range(0, len(block.ids), TILE):
                    rows = np.arange(a, min(a + TILE, len(block.ids)))
                    score = strassen(block.parts[rows], parts)
                    other = block.labels[rows][:, None] != labels[None, :]
                    for slots in by_anchor[:, rows]:
                        have = np.flatnonzero(slots >= 0)
                        s = slots[have]
                        mine = score[have]
                        i, j = np.nonzero((mine >= np.maximum(least[s], heaps.worst[s])[:, None]) & (mine <= most[s][:, None]) & other[have])
                        heaps.offer(s[i], mine[i, j], ids[j], null[j])
        slot, score, ids, null = heaps.rows()
        a = anchor[slot]
        positive = pa.array(pos_ids[slot], mask=pos_null[slot].astype(bool))
        table = pa.Table.from_arrays([pa.array(slot), pa.array(block.ids[a]), positive, pa.array(pos_score[slot]), pa.array(score),
                                      pa.array(ids, mask=null.astype(bool))],
                                     names=["slot", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"])
        yield from table.to_batches(max_chunksize=10_000)

    rows = items.mapInArrow(run, "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_score bigint, negative_id bigint")
    top = top_k_per(rows, ["slot"], [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()], k)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def usable(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows with a label and a whole vector of finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return (rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
            .select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")))


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int, int] = (LOW, HIGH, WHOLE), scale: int = SCALE, anchors: int = ANCHORS) -> DataFrame:
    """``RESULT`` rows of ``usable`` rows; ``is_anchor`` is a condition on vec_id, label and vector."""
    spark = rows.sparkSession
    items = saved(rows.select("vec_id", "label", "vector"), "negative-items")
    queries = with_sequence(items.where(is_anchor).where("vec_id is not null"), ["vec_id", "label", F.xxhash64("vector")], "_n", start=0)
    n = queries.count()
    base = shared_dir(spark, f"negatives-{uuid.uuid4().hex}")
    done = []
    for first in range(0, n, anchors):
        block = Block(queries.where(F.col("_n").between(first, first + anchors - 1)).orderBy("_n").toArrow(), scale)
        found = _best_of_label(items, block, positives + 1).toArrow()       # at most anchors * (positives + 1) rows
        out = _best_in_windows(items, block, _positives(found, block, positives), negatives, *window)
        done.append(f"{base}/{first}")
        out.write.parquet(done[-1])
    return spark.read.schema(RESULT).parquet(*done) if done else spark.createDataFrame([], RESULT)


def oracle() -> str:
    """The contract's question in DuckDB SQL over the table embeddings."""
    return """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q, row_number() over () as rn from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rn as arn, a.vec_id as anchor_id, a.label as al, b.rn, b.vec_id, b.label,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
    from v a join v b on a.vec_id % 100 = 0 and a.rn <> b.rn),
p as (select * from s where label = al qualify row_number() over (partition by arn order by score desc, vec_id) <= 5),
n as (select p.arn, p.rn, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.arn, p.rn order by s.score desc, s.vec_id) as rank
    from p join s on s.arn = p.arn and s.label <> p.al and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
