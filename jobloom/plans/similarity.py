"""Similarity ranking, rank fusion, prompts and the ranked-CSV sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions.scoring import binary_softmax
from ..operators import ranking as rk
from ..operators import similar as sm
from ..session import shared_dir
from ..sources.fixtures import Ats
from .registry import register

CV_ID = 0
LINK_BASE = "https://jobs.example.com/job-detail/"
TOP_N = 20

_SQL_DOT = f"""
cv as (select embedding as q from embeddings where vec_id = {CV_ID} limit 1),
ds as (select e.vec_id, round(list_sum(list_transform(range(1, len(e.embedding) + 1),
              lambda i: cast(e.embedding[i] as double) * cast(cv.q[i] as double))), 6) as score
       from embeddings e, cv where e.vec_id <> {CV_ID})"""


@register("dot_similarity", sql=f"""
with {_SQL_DOT}
select vec_id, score from ds""")
def q_dot_similarity(spark, sf_dir):
    """Unnormalised dot product of every job vector with the CV vector (id 0)."""
    a = Ats(spark, sf_dir)
    return rk.dot_scores(a.embeddings, "vec_id", "embedding", CV_ID)


@register("rank_similarity", sql=f"""
with {_SQL_DOT}
select vec_id, score, cast(row_number() over (order by score, vec_id) - 1 as bigint) as rank from ds""")
def q_rank_similarity(spark, sf_dir):
    """Jobs ranked by similarity to the CV (0 = least similar, ties by id)."""
    a = Ats(spark, sf_dir)
    return rk.rank_by_score(rk.dot_scores(a.embeddings, "vec_id", "embedding", CV_ID), "vec_id")


CV_EVERY, MANY_K = 20, 10


@register("rank_similarity_many", sql=f"""
with s as (select q.vec_id as cv_id, e.vec_id, round(list_sum(list_transform(range(1, len(e.embedding) + 1),
              lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))), 6) as score
           from embeddings q, embeddings e where q.vec_id % {CV_EVERY} = 0 and e.vec_id <> q.vec_id)
select cv_id, vec_id, score, row_number() over (partition by cv_id order by score desc, vec_id) as rank from s
qualify rank <= {MANY_K}""")
def q_rank_similarity_many(spark, sf_dir, k: int = MANY_K):
    """The k most similar vectors of every CV (each twentieth vector is one) in one job."""
    a = Ats(spark, sf_dir)
    items = sm.by_norm(a.embeddings, "vec_id", "embedding")
    return sm.top_similar(items.where(F.col("id") % CV_EVERY == 0), items, k).select(
        F.col("query_id").alias("cv_id"), F.col("id").alias("vec_id"), "score", "rank")


@register("rank_argsort_compat", sql=f"""
with {_SQL_DOT},
pos as (select vec_id, row_number() over (order by vec_id) - 1 as pos from ds),
rnk as (select vec_id, row_number() over (order by score, vec_id) - 1 as rank from ds),
holder as (select rnk.rank as pos, pos.pos as compat_rank from rnk join pos using (vec_id))
select pos.vec_id, cast(holder.compat_rank as bigint) as compat_rank from pos join holder using (pos)""")
def q_rank_argsort_compat(spark, sf_dir):
    """The literal argsort pairing: item i gets the index of the i-th smallest score."""
    a = Ats(spark, sf_dir)
    return rk.argsort_compat(rk.dot_scores(a.embeddings, "vec_id", "embedding", CV_ID), "vec_id")


@register("binary_softmax", sql="""
select event_id, round(1.0 / (1.0 + exp(0.0 - value)), 6) as p_yes from events""")
def q_binary_softmax(spark, sf_dir):
    """P(yes) of a two-logit softmax, with the event value as the 'yes' logit and 0 as 'no'."""
    a = Ats(spark, sf_dir)
    return a.events.select("event_id", F.round(binary_softmax(F.col("value"), F.lit(0.0)), 6).alias("p_yes"))


def _sql_fill(template: str, **cols) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for k, v in cols.items():
        out = out.replace("{" + k + "}", "' || " + v + " || '")
    return out


def _fill(template: str, **cols):
    parts, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts += [F.lit(rest[:i]), cols[rest[i + 1:j]]]
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


RESUME_CHARS = 250


@register("prompt_text", sql=f"""
with cvt as (select substr(text, 1, {RESUME_CHARS}) as resume from ats_resumes where applicant_id = {CV_ID})
select job_id, {_sql_fill(cat.BULLET_PROMPT, job_description='text')} as bullet_prompt,
       {_sql_fill(cat.SUMMARY_PROMPT, job_description='text')} as summary_prompt,
       {_sql_fill(cat.GRADE_PROMPT, job_description='text', resume='cvt.resume')} as grade_prompt
from ats_postings, cvt""")
def q_prompt_text(spark, sf_dir):
    """The three prompt texts per posting; the grading prompt carries the first 250 characters
    of the configured résumé (one bounded value, read once)."""
    a = Ats(spark, sf_dir)
    row = a.ats_resumes.where(F.col("applicant_id") == CV_ID).select(
        F.substring("text", 1, RESUME_CHARS).alias("r")).first()
    resume = F.lit(row["r"] if row else "")
    t = F.col("text")
    return a.ats_postings.select(
        "job_id", _fill(cat.BULLET_PROMPT, job_description=t).alias("bullet_prompt"),
        _fill(cat.SUMMARY_PROMPT, job_description=t).alias("summary_prompt"),
        _fill(cat.GRADE_PROMPT, job_description=t, resume=resume).alias("grade_prompt"))


def _link(key):
    return F.concat(F.lit(LINK_BASE), F.col(key).cast("string"))


def similarity_ranking(a: Ats):
    r = rk.rank_by_score(rk.dot_scores(a.embeddings, "vec_id", "embedding", CV_ID), "vec_id")
    return r.select(F.col("vec_id").alias("job_id"), "rank", _link("vec_id").alias("link"))


def label_ranking(a: Ats):
    """Rank of labelled postings by quality then id (0 = lowest), a fixed supervised score."""
    lab = a.labels.select(F.col("doc_id").alias("job_id"), F.col("quality").cast("double").alias("score"))
    r = rk.rank_by_score(lab, "job_id")
    return r.select("job_id", "rank", _link("job_id").alias("link"))


_SQL_FUSE = f"""{_SQL_DOT},
r1 as (select vec_id as job_id, row_number() over (order by score, vec_id) - 1 as rank,
              '{LINK_BASE}' || cast(vec_id as varchar) as link, 0 as src from ds),
r2 as (select doc_id as job_id, row_number() over (order by cast(quality as double), doc_id) - 1 as rank,
              '{LINK_BASE}' || cast(doc_id as varchar) as link, 1 as src from labels),
u as (select * from r1 union all select * from r2),
fused as (select job_id, sum(rank / 2.0) as fused_rank, arg_max(link, src) as link from u group by job_id)"""


@register("rank_fusion", sql=f"""
with {_SQL_FUSE}
select job_id, fused_rank, link from fused""")
def q_rank_fusion(spark, sf_dir):
    """Fuse the similarity ranking and the label ranking: sum of half-ranks per job."""
    a = Ats(spark, sf_dir)
    return rk.fuse_ranks([similarity_ranking(a), label_ranking(a)], "job_id").select(
        "job_id", "fused_rank", "link")


def fused_order(direction: str = "best"):
    """Ranks grow with the score (0 = least similar), so best-first is descending fused rank;
    ``direction="literal"`` keeps the ascending order of the original pipeline."""
    if direction == "best":
        return [F.col("fused_rank").desc(), F.col("job_id")]
    if direction == "literal":
        return [F.col("fused_rank"), F.col("job_id")]
    raise ValueError(direction)


@register("top_ranked", sql=f"""
with {_SQL_FUSE}
select job_id, fused_rank, link from fused order by fused_rank desc, job_id limit {TOP_N}""")
def q_top_ranked(spark, sf_dir, n: int = TOP_N, direction: str = "best"):
    """Best n of the fused ranking (highest fused rank first, ties by id)."""
    a = Ats(spark, sf_dir)
    f = rk.fuse_ranks([similarity_ranking(a), label_ranking(a)], "job_id")
    return f.orderBy(*fused_order(direction)).limit(n).select("job_id", "fused_rank", "link")


@register("sink_csv_ranks", sql=f"""
with {_SQL_FUSE},
t as (select job_id, fused_rank, link from fused order by fused_rank desc, job_id limit {TOP_N})
select cast(row_number() over (order by fused_rank desc, job_id) - 1 as bigint) as idx,
       cast(job_id as varchar) as "Job ID", link as "Link", fused_rank as "Rank" from t""")
def q_sink_csv_ranks(spark, sf_dir, n: int = TOP_N, run_id: str | None = None, direction: str = "best"):
    """Write the top fused ranks as CSV (header, index column, Job ID, Link, Rank) to the
    shared folder and read the file back."""
    a = Ats(spark, sf_dir)
    order = fused_order(direction)
    top = rk.fuse_ranks([similarity_ranking(a), label_ranking(a)], "job_id").orderBy(*order).limit(n)
    # the window runs over the n rows left after the limit
    out = top.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("idx"),
                     F.col("job_id").cast("string").alias("Job ID"), F.col("link").alias("Link"),
                     F.col("fused_rank").alias("Rank"))
    path = shared_dir(spark, "job_rank", run_id or uuid.uuid4().hex)
    write_rank_csv(out, path)
    return spark.read.option("header", True).schema("idx long, `Job ID` string, Link string, Rank double").csv(path)


def write_rank_csv(df, path: str) -> None:
    """A ranked result is at most top-n rows, so one output file keeps it readable as a report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
