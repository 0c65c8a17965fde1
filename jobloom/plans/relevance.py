"""Relevance model queries: training set, TF-IDF encoding, fit, score, fused recommendation."""

from __future__ import annotations

import uuid

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..operators import relevance as rel
from ..session import shared_dir
from ..sources.fixtures import Ats
from .registry import register
from .similarity import LINK_BASE, TOP_N, fused_order, similarity_ranking


def training_set(a: Ats):
    return a.documents.join(a.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")


@register("training_set", sql="""
select d.doc_id, d.lang, d.n_chars, l.quality as label from documents d join labels l on l.doc_id = d.doc_id""")
def q_training_set(spark, sf_dir):
    """Labelled postings: documents joined to their labels."""
    a = Ats(spark, sf_dir)
    return training_set(a).select("doc_id", "lang", "n_chars", "label")


@register("encode_tfidf")
def q_encode_tfidf(spark, sf_dir):
    """Unit-length TF-IDF vector of every document (hashed terms, stop words removed)."""
    a = Ats(spark, sf_dir)
    docs = a.documents.select("doc_id", "text")
    model = rel.tfidf_pipeline("text").fit(docs)
    return model.transform(docs).select("doc_id", F.size("_words").cast("long").alias("n_terms"), "vector")


def _fit(spark, a: Ats, counts):
    path = shared_dir(spark, "models", "relevance-" + uuid.uuid4().hex)
    train = counts.join(a.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rel.fit_relevance(train, "text", "label", path)


@register("fit_relevance")
def q_fit_relevance(spark, sf_dir):
    """Fit the relevance model on four fifths of the labelled documents (by a hash of the id); report
    sizes and the AUC on the fifth it has not seen."""
    a = Ats(spark, sf_dir)
    rows = training_set(a).select("doc_id", "text", F.col("label").cast("double").alias("label"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    train, test = rows.where(~held), rows.where(held)
    model = rel.fit_relevance(train, "text", "label", shared_dir(spark, "models", "relevance-" + uuid.uuid4().hex))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(model.transform(test))
    return rows.agg(F.sum(F.when(~held, 1).otherwise(0)).alias("n_train"), F.sum(F.when(held, 1).otherwise(0)).alias("n_held_out"),
                    F.sum("label").cast("long").alias("n_positive")).select(
        "n_train", "n_held_out", "n_positive", F.lit(rel.NUM_FEATURES).alias("n_features"), F.lit(float(auc)).alias("held_out_auc"))


def letter_shares():
    """A deterministic encoder: shares of the 26 letters in each text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: [[t.lower().count(c) / max(1, len(t)) for c in letters] for t in texts]


@register("encode_external", sql="""
select doc_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
  lambda c: round(cast(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')) as double) / greatest(1, length(coalesce(text, ''))), 6)) as embedding
from documents""")
def q_encode_external(spark, sf_dir):
    """Vectors of every document from a pluggable encoder (here a deterministic one)."""
    a = Ats(spark, sf_dir)
    v = rel.encode_with(a.documents, "doc_id", "text", "letter_shares", letter_shares)
    return v.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def model_ranking(spark, a: Ats):
    """Ranks of all documents by the fitted model; texts are cut once for the fit and the scores."""
    counts = rel.term_counts(a.documents.select("doc_id", "text"), "text")
    model = _fit(spark, a, counts)
    # the ranking reads its input twice (range bounds, rows)
    scores = rel.score_relevance(model, counts, "doc_id").checkpoint(eager=True)
    return rk.rank_by_score(scores.withColumnRenamed("p_yes", "score"), "doc_id")


@register("score_relevance")
def q_score_relevance(spark, sf_dir):
    """P(relevant) of every document from the fitted model, ranked ascending."""
    a = Ats(spark, sf_dir)
    r = model_ranking(spark, a)
    return r.select("doc_id", F.round("score", 6).alias("p_yes"), "rank")


@register("recommend_fused")
def q_recommend_fused(spark, sf_dir, n: int = TOP_N):
    """Similarity rank and model rank fused per job (sum of half-ranks), best n."""
    a = Ats(spark, sf_dir)
    m = model_ranking(spark, a).select(F.col("doc_id").alias("job_id"), "rank",
                                       F.concat(F.lit(LINK_BASE), F.col("doc_id").cast("string")).alias("link"))
    fused = rk.fuse_ranks([similarity_ranking(a), m], "job_id")
    return fused.orderBy(*fused_order("best")).limit(n).select("job_id", "fused_rank", "link")
