"""Similarity ranking and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import dot
from .sequence import with_sequence


def query_vector(vectors: DataFrame, id_col: str, vec_col: str, query_id) -> Column:
    """The query (CV) vector as a literal array column: one bounded row read once, so every
    task gets it with the plan instead of through a join."""
    row = vectors.where(F.col(id_col) == query_id).select(vec_col).first()
    if row is None:
        raise KeyError(f"no vector with {id_col} = {query_id}")
    return F.array(*[F.lit(float(x)).cast("double") for x in row[0]])


def dot_scores(vectors: DataFrame, id_col: str, vec_col: str, query_id, digits: int = 6) -> DataFrame:
    q = query_vector(vectors, id_col, vec_col, query_id)
    return (vectors.where(F.col(id_col) != query_id)
                   .select(id_col, F.round(dot(F.col(vec_col), q), digits).alias("score")))


def rank_by_score(scores: DataFrame, id_col: str, score_col: str = "score", rank_col: str = "rank") -> DataFrame:
    """0-based ascending rank (ties by id), numbered without a single-partition window."""
    r = with_sequence(scores, [score_col, id_col], rank_col, start=0)
    return r


def argsort_compat(scores: DataFrame, id_col: str, score_col: str = "score") -> DataFrame:
    """Literal ``zip(items, argsort(scores))``: the item at list position p gets the list
    position of the p-th smallest score (not its own rank).  List order = id order."""
    pos = with_sequence(scores.select(id_col), [id_col], "pos", start=0)
    ranked = with_sequence(scores.select(id_col, score_col), [score_col, id_col], "rank", start=0)
    # position of the item holding each rank, keyed by that rank
    holder = ranked.join(pos, id_col).select(F.col("rank").alias("pos"), F.col("pos").alias("compat_rank"))
    return pos.join(holder, "pos").select(id_col, "compat_rank")


def fuse_ranks(rankings: list[DataFrame], key: str, rank_col: str = "rank", link_col: str = "link") -> DataFrame:
    """Sum of half-ranks per key over the rankings (a key missing from one ranking gets only
    the other's half); the link of the last ranking that has the key is kept."""
    parts = [r.select(key, (F.col(rank_col) / 2.0).alias("half"), F.col(link_col).alias("link"),
                      F.lit(i).alias("src")) for i, r in enumerate(rankings)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.sum("half").alias("fused_rank"), F.max_by("link", "src").alias("link"))
