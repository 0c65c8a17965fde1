"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes have it set.
Fingerprints that differ in at most ``max_bits`` bits are linked.  The 64 bits are cut into
segments with a radius each, so chosen that two fingerprints within ``max_bits`` must agree in
at least one segment up to its radius: each distinct fingerprint enters one table row for each
segment, the small Hamming ball around its segment value is enumerated and looked up in the
table by an equi-join, and the complete distance is verified on the matches.

Exact copies meet in one fingerprint before any join.  The lookup is an inner equi-join, whose
skewed partitions Spark splits at run time, and what a task verifies leaves it as a spanning
forest, so that no group is spelled out in pairs; no link is lost.  Joins of fingerprints are
merged at any size: none is broadcast, so the driver holds no table that grows with the documents.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other;
rows with a null doc_id are fingerprinted and link others but never name a component (a
component of only such rows has a null id); repeated rows share their component; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_rows, saved, text_rows
from .components import connected_components, forest

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SEGMENTS = 3
NO_ID = 1 << 62              # doc_ids lie below
_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text over XXH64 (seed 42) of its word shingles, repeats included."""
    words = _BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())   # bytes: only A-Z change
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        a, b = starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist()
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), "<u8", len(a))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed bigint."""
    def make():
        return lambda rows: ((d, fingerprint(t, shingle)) for d, t in rows)
    return map_rows(text_rows(docs), "doc_id bigint, fp bigint", make)


def segment_plan(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment.  The radii plus one sum to max_bits + 1, so
    by the pigeonhole principle two fingerprints within max_bits agree somewhere up to the radius."""
    segments = min(segments, max_bits + 1)
    base, more = divmod(max_bits + 1, segments)
    wide, extra = divmod(64, segments)
    out, low = [], 0
    for k in range(segments):
        width = wide + (k < extra)
        out.append((low, width, base + (k < more) - 1))
        low += width
    return out


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A spanning set (a, b) of the links between the distinct values of ``fps.fp``."""
    plan = segment_plan(max_bits)
    segment = lambda low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("seg"), segment(low, width).alias("val")) for k, (low, width, _) in enumerate(plan)])).alias("s")
    ).select("fp", "s.seg", "s.val")
    balls = F.coalesce(*[F.when(F.col("seg") == k, F.array(*[F.lit(x).cast("bigint") for x in _ball(width, radius)]))
                         for k, (_, width, radius) in enumerate(plan)])
    probes = rows.select("fp", "seg", F.explode(balls).alias("x"), "val").select(
        "fp", "seg", F.col("val").bitwiseXOR(F.col("x")).alias("val"))

    # an equi-join whose skewed partitions (segment values shared by many) Spark may split on either side; it is
    # merged, as Spark sizes exploded rows like those before the explode and would broadcast them
    found = (probes.withColumnRenamed("fp", "a").join(rows.withColumnRenamed("fp", "b").hint("merge"), ["seg", "val"])
             .where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return forest(found.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id reachable over links) and group_id, a bigint that all rows of a component share."""
    fps = saved(fingerprints(docs, shingle), "simhash-fp")
    # a fingerprint's node is its smallest doc_id, so that a component is named by the smallest of all;
    # one of rows without ids only gets a node above any id
    known = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select(
        "fp", F.coalesce("least", F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 60))).alias("node")), "simhash-distinct")
    edges = links(known.select("fp"), max_bits)
    for end in ("a", "b"):
        edges = edges.join(known.withColumnRenamed("fp", end).hint("merge"), end).drop(end).withColumnRenamed("node", end)
    comp = connected_components(edges)
    of_fp = known.join(comp.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("group_id"))
    return fps.join(of_fp.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("group_id") < NO_ID, F.col("group_id")).alias("component_id"), "group_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id (of rows that repeat
    this id any one; of a component without ids any one)."""
    found = saved(near_duplicates(docs, shingle, max_bits), "simhash-groups")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    chosen = found.where("doc_id <=> component_id")
    named = chosen.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias("__keep"))
    out = docs.join(named, docs["doc_id"] == F.col("__keep"), "left_semi")
    if not repeated.limit(1).count():
        return out
    # an id on several rows does not tell them apart: these few rows are matched by fingerprint too
    again = docs.join(repeated.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    marks = chosen.select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__of"), F.col("group_id").alias("__group")).distinct()
    marked = with_fingerprint(again, shingle)
    kept = marked.join(marks, marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of"))
                       ).dropDuplicates(["__group"]).select(*[marked[c] for c in docs.columns])
    return out.unionByName(kept)


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "__fp") -> DataFrame:
    """``docs`` with all its columns and the fingerprint as 16 hex digits."""
    def run(batches):
        for batch in batches:
            fps = [f"{fingerprint(t, shingle) % (1 << 64):016x}" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.string())], names=[*batch.schema.names, name])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))
