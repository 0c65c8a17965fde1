"""Connected components over edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved

MAX_OPEN_NODES = 500_000     # nodes that one task holds before it emits its forest and goes on


def forest(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a spanning forest of them (same connectivity,
    fewer rows): union-find over a bounded number of open nodes, emitted and begun anew when full."""
    def make():
        def run(rows):
            parent: dict[int, int] = {}

            def find(x):
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in rows:
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    yield (max(a, b), min(a, b))
                if len(parent) > MAX_OPEN_NODES:
                    parent.clear()
        return run
    return map_rows(edges.select("a", "b"), "a bigint, b bigint", make)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint); component is the
    smallest node reachable.  Self loops are ignored; nodes without an edge do not appear.

    Each round links the neighbours of a node to its smallest neighbour; the rounds needed grow
    with the logarithm of the number of nodes.  A round is written to the shared folder, so no
    lineage grows, and nothing but an edge count and checksum reaches the driver (joins are merged, not broadcast).
    """
    def checksum(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = saved(forest(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       ).distinct(), "cc")
    before = checksum(cur)
    if not before[0]:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        cur = saved(small, "cc")
        now = checksum(cur)
        if now == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
