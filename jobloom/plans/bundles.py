"""Parse bundles (one row per posting / résumé) and the résumé onboarding flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import matching as mt
from ..operators.sequence import with_sequence
from ..sources.fixtures import Ats
from .ats import jobs_model
from .registry import register
from .text import (AS_OF, OPEN_END_YEAR, sql_clean, sql_interval, sql_jd_years, sql_positions, sql_sections,
                   sql_skills, sql_titles, sql_top_keywords)


def _joined(df, id_col: str, order_col: str, value_col: str, sep: str, name: str):
    """Values of one document's rows joined in order (the rows come from a single text)."""
    return df.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, value_col))),
                                 lambda s: s[value_col]), sep).alias(name))


def _wide(docs, id_col: str, texts: dict, numbers: dict):
    """``docs`` (id and the text as full_text) with one column for each part (id, value under the part's name): the
    parts' rows are stacked and meet in one aggregation, whose shuffle the join with the texts reuses."""
    long = None
    for name, df in {**texts, **numbers}.items():
        is_text = name in texts
        row = df.select(id_col, F.lit(name).alias("_part"), (F.col(name) if is_text else F.lit(None).cast("string")).alias("_text"),
                        (F.lit(None) if is_text else F.col(name)).cast("double").alias("_number"))
        long = row if long is None else long.unionByName(row)
    pick = lambda name, c: F.max(F.when(F.col("_part") == name, F.col(c))).alias(name)
    wide = long.groupBy(id_col).agg(*[pick(n, "_text") for n in texts], *[pick(n, "_number") for n in numbers])
    return docs.select(id_col, F.col("text").alias("full_text")).join(wide, id_col, "left").select(
        id_col, *[F.coalesce(n, F.lit("")).alias(n) for n in texts], *numbers, "full_text")


def _text_bundle(docs, id_col: str, sections=None):
    skills = _joined(dc.skills_extract(docs, id_col, "text"), id_col, "rank", "skill", ", ", "skills")
    kws = _joined(dc.top_keywords(docs, id_col, "text"), id_col, "rank", "keyword", ", ", "keywords")
    sec = sections if sections is not None else dc.resume_sections(docs, id_col, "text")
    secs = _joined(sec, id_col, "first_seen", "section", ", ", "sections")
    return skills, kws, secs


@register("parse_postings", sql=f"""
with {sql_skills('ats_postings', 'job_id', 'text')}, {sql_top_keywords('ats_postings', 'job_id', 'text')},
{sql_sections('ats_postings', 'job_id', 'text')},
sk_j as (select job_id, string_agg(skill, ', ' order by rank) as skills from sk group by job_id),
kw_j as (select job_id, string_agg(keyword, ', ' order by rank) as keywords from kw group by job_id),
se_j as (select job_id, string_agg(section, ', ' order by first_seen) as sections from sections group by job_id)
select p.job_id, coalesce(sk_j.skills, '') as skills, coalesce(kw_j.keywords, '') as keywords,
       cast({sql_jd_years(sql_clean('p.text'))} as bigint) as experience_years, coalesce(se_j.sections, '') as sections, p.text as full_text
from ats_postings p left join sk_j using (job_id) left join kw_j using (job_id) left join se_j using (job_id)""")
def q_parse_postings(spark, sf_dir):
    """Everything extracted from a job description: skills, top keywords, years, sections, and the text."""
    a = Ats(spark, sf_dir)
    docs = a.ats_postings
    skills, kws, secs = _text_bundle(docs, "job_id")
    years = dc.posting_years(docs, "job_id", "text", OPEN_END_YEAR).withColumnRenamed("years", "experience_years")
    out = _wide(docs, "job_id", {"skills": skills, "keywords": kws, "sections": secs}, {"experience_years": years})
    return out.withColumn("experience_years", F.col("experience_years").cast("long"))


def education_or_sentences(docs, id_col: str, sections=None):
    """Education entries of the education section; résumés without one fall back to
    sentences that mention an education keyword."""
    entries = dc.education_entries(docs, id_col, "text", sections).select(
        id_col, F.col("entry_no").alias("n"), "entry")
    missing = docs.join(entries.select(id_col).distinct(), id_col, "left_anti")
    sentences = dc.education_sentences(missing, id_col, "text").select(
        id_col, F.col("sentence_no").alias("n"), F.col("sentence").alias("entry"))
    return entries.unionByName(sentences)


@register("parse_resumes", sql=f"""
with {sql_skills('ats_resumes', 'applicant_id', 'text')}, {sql_top_keywords('ats_resumes', 'applicant_id', 'text')},
{sql_sections('ats_resumes', 'applicant_id', 'text')}, {sql_positions('applicant_id')},
{sql_titles('ats_resumes', 'applicant_id', 'text')},
iv as {sql_interval('education', 'applicant_id')},
el as (select ln.applicant_id, ln.pos, {'regexp_replace(ln.line, ' + "'^" + tx.WS + "+|" + tx.WS + "+$', '', 'g')"} as s
       from ln join iv using (applicant_id) where ln.pos >= iv.start_line and ln.pos < iv.end_line),
ei as (select *, sum(case when s = '' then 1 else 0 end) over (partition by applicant_id order by pos
               rows between unbounded preceding and current row) as island from el),
ent as (select applicant_id, island as n, string_agg(s, ' ' order by pos) as entry from ei where s <> '' group by applicant_id, island),
sk_j as (select applicant_id, string_agg(skill, ', ' order by rank) as skills from sk group by applicant_id),
kw_j as (select applicant_id, string_agg(keyword, ', ' order by rank) as keywords from kw group by applicant_id),
se_j as (select applicant_id, string_agg(section, ', ' order by first_seen) as sections from sections group by applicant_id),
ed_j as (select applicant_id, string_agg(entry, ' | ' order by n) as education from ent group by applicant_id),
ti_j as (select applicant_id, string_agg(title, ', ' order by rank) as titles from titles group by applicant_id),
yo as (select applicant_id, sum(greatest(period, 0)) as months from positions group by applicant_id),
po_j as (select applicant_id, string_agg(title || ' (' || start || '..' || "end" || ')', ' | ' order by line_no) as positions
         from positions group by applicant_id)
select r.applicant_id, coalesce(sk_j.skills, '') as skills, coalesce(kw_j.keywords, '') as keywords,
       coalesce(ed_j.education, '') as education, round(coalesce(yo.months, 0) / 12.0, 2) as yoe,
       coalesce(se_j.sections, '') as sections, coalesce(ti_j.titles, '') as titles,
       coalesce(po_j.positions, '') as positions, r.text as full_text
from ats_resumes r left join po_j using (applicant_id) left join sk_j using (applicant_id) left join kw_j using (applicant_id)
left join se_j using (applicant_id) left join ed_j using (applicant_id) left join ti_j using (applicant_id)
left join yo using (applicant_id)""")
def q_parse_resumes(spark, sf_dir, as_of: str = AS_OF):
    """Everything extracted from a résumé: skills, keywords, education, years, sections, titles,
    positions held, and the text."""
    a = Ats(spark, sf_dir)
    docs = a.ats_resumes
    # sections and positions are read several times: written once
    sections = dc.resume_sections(docs, "applicant_id", "text").checkpoint(eager=True)
    skills, kws, secs = _text_bundle(docs, "applicant_id", sections)
    edu = _joined(education_or_sentences(docs, "applicant_id", sections), "applicant_id", "n", "entry", " | ",
                  "education")
    titles = _joined(dc.job_titles(docs, "applicant_id", "text"), "applicant_id", "rank", "title", ", ", "titles")
    positions = dc.resume_positions(docs, "applicant_id", "text", as_of, sections).checkpoint(eager=True)
    yoe = dc.resume_yoe(docs, "applicant_id", "text", as_of, positions)
    held = _joined(positions.withColumn("held", F.concat("title", F.lit(" ("), "start", F.lit(".."), "end", F.lit(")"))),
                   "applicant_id", "line_no", "held", " | ", "positions")
    return _wide(docs, "applicant_id", {"skills": skills, "keywords": kws, "education": edu, "sections": secs, "titles": titles, "positions": held},
                 {"yoe": yoe})


@register("onboard_applicant", sql=f"""
with {sql_skills('ats_resumes', 'applicant_id', 'text')}, {sql_sections('ats_resumes', 'applicant_id', 'text')},
{sql_positions('applicant_id')},
yo as (select r.applicant_id, round(coalesce(sum(greatest(p.period, 0)), 0) / 12.0, 2) as years
       from ats_resumes r left join positions p using (applicant_id) group by r.applicant_id),
code as (select applicant_id, printf('APP%03d', row_number() over (order by applicant_id)) as applicant_code from ats_resumes),
jm as (select job_id, list_transform(string_split(skills_required, ' '), lambda x: lower(trim(x))) as skills,
              case when regexp_matches(regexp_extract(experience_required, '^\\s*(\\S+)', 1), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                   then try_cast(regexp_extract(experience_required, '^\\s*(\\S+)', 1) as double) end as req_years
       from ats_jobs where status = 'Open'),
ask as (select distinct applicant_id, lower(trim(skill)) as skill from sk),
js as (select job_id, unnest(skills) as skill, unnest(generate_series(1, len(skills))) as pos from jm),
hits as (select a.applicant_id, js.job_id, count(distinct js.pos) as n_hit
         from ask a join js on contains(js.skill, a.skill) or contains(a.skill, js.skill) group by a.applicant_id, js.job_id),
p as (select yo.applicant_id, jm.job_id,
             case when len(jm.skills) = 0 then 100.0 else cast(coalesce(h.n_hit, 0) as double) / len(jm.skills) * 100.0 end as s,
             case when yo.years is null or jm.req_years is null then 50.0 when yo.years >= jm.req_years then 100.0
                  else yo.years / jm.req_years * 100.0 end as e
      from yo cross join jm left join hits h on h.applicant_id = yo.applicant_id and h.job_id = jm.job_id),
scored as (select applicant_id, job_id, round(s * 0.6 + e * 0.4, 2) as match_score from p),
r as (select *, row_number() over (partition by applicant_id order by match_score desc, job_id) as rank from scored)
select code.applicant_code, r.job_id, r.match_score, cast(r.rank as bigint) as rank
from r join code using (applicant_id) where r.rank <= 5""")
def q_onboard_applicant(spark, sf_dir, k: int = 5, as_of: str = AS_OF):
    """Résumé to recommendations: parse skills and years, assign an applicant code, then the
    top-k open jobs for the new applicant (set-based scoring, no applicant x job pairs)."""
    a = Ats(spark, sf_dir)
    docs = a.ats_resumes
    skills = dc.skills_extract(docs, "applicant_id", "text").select(
        "applicant_id", F.lower(F.trim("skill")).alias("skill"))
    yoe = dc.resume_yoe(docs, "applicant_id", "text", as_of)
    codes = with_sequence(docs.select("applicant_id"), ["applicant_id"], "n").select(
        "applicant_id", F.format_string("APP%03d", F.col("n")).alias("applicant_code"))
    jobs = jobs_model(a).where(F.col("status") == "Open")
    top = mt.top_k_jobs_by_list(skills, yoe.select("applicant_id", F.col("yoe").cast("double").alias("years")),
                                jobs.select("job_id", "skills", "req_years"), k)
    return (top.join(codes, F.col("group_id") == F.col("applicant_id"))
               .select("applicant_code", F.col("item_id").alias("job_id"), "match_score", "rank"))
