"""Applicant-tracking queries: scoring, recommendations, applicant/job views, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import experience_match_pct, parse_years, skill_match_pct
from ..operators import matching as mt
from ..functions import catalog as cat
from ..operators.sequence import with_sequence
from ..operators.topk import first_wins, last_wins, top_k_per
from ..session import release
from ..sources.fixtures import Ats
from .registry import register


# ---------------------------------------------------------------- model ---

def jobs_model(a: Ats) -> DataFrame:
    """Jobs with a normalised skill list (space-separated words) and parsed required years."""
    j = a.ats_jobs
    skills = F.transform(F.split(F.col("skills_required"), " ", -1), lambda x: F.lower(F.trim(x)))
    return j.select("*", skills.alias("skills"), parse_years("experience_required").alias("req_years"))


def applicant_model(a: Ats) -> DataFrame:
    return a.ats_applicants.select("applicant_id", "name", "experience",
                                   parse_years("experience").alias("years"))


def applicant_skills(a: Ats) -> DataFrame:
    return a.ats_resume_skills.select(F.col("user_id").alias("applicant_id"),
                                      F.lower(F.trim("skill")).alias("skill"))


def scored_pairs(a: Ats, pairs: DataFrame) -> DataFrame:
    """skills%, experience% and weighted score for given (applicant_id, job_id) pairs: each pair
    carries its applicant's and its job's skill arrays (both bounded by one profile or posting)."""
    own = applicant_skills(a).groupBy("applicant_id").agg(F.collect_set("skill").alias("own"))
    jobs = jobs_model(a).select("job_id", F.col("skills").alias("wanted"), "req_years")
    people = applicant_model(a).select("applicant_id", "years").join(own, "applicant_id", "left")
    p = pairs.select("applicant_id", "job_id").distinct().join(jobs, "job_id").join(people, "applicant_id")
    none = F.array().cast("array<string>")
    skills = skill_match_pct(F.coalesce("own", none), F.col("wanted"))
    exp = experience_match_pct(F.col("years"), F.col("req_years"))
    return (p.select("applicant_id", "job_id", skills.alias("skills_match"), exp.alias("experience_match"))
             .withColumn("match_score", F.round(F.col("skills_match") * 0.6 + F.col("experience_match") * 0.4, 2)))


# ---------------------------------------------------------- oracle parts ---

_SQL_MODEL = """
jm as (select job_id, title, company, status, experience_required,
              list_transform(string_split(skills_required, ' '), lambda x: lower(trim(x))) as skills,
              case when regexp_matches(regexp_extract(experience_required, '^\\s*(\\S+)', 1), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                   then try_cast(regexp_extract(experience_required, '^\\s*(\\S+)', 1) as double) end as req_years
       from ats_jobs),
am as (select applicant_id, name,
              case when regexp_matches(regexp_extract(experience, '^\\s*(\\S+)', 1), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                   then try_cast(regexp_extract(experience, '^\\s*(\\S+)', 1) as double) end as years
       from ats_applicants),
ask as (select distinct user_id as applicant_id, lower(trim(skill)) as skill from ats_resume_skills),
js as (select job_id, unnest(skills) as skill, unnest(generate_series(1, len(skills))) as pos from jm),
hits as (select a.applicant_id, js.job_id, count(distinct js.pos) as n_hit
         from ask a join js on contains(js.skill, a.skill) or contains(a.skill, js.skill)
         group by a.applicant_id, js.job_id)"""

_SQL_SCORE = """
case when len(jm.skills) = 0 then 100.0 else cast(coalesce(h.n_hit, 0) as double) / len(jm.skills) * 100.0 end"""
_SQL_EXP = """
case when am.years is null or jm.req_years is null then 50.0 when am.years >= jm.req_years then 100.0
     else am.years / jm.req_years * 100.0 end"""


# --------------------------------------------------------------- queries ---

def sql_recommend_jobs(k: int) -> str:
    """CTE ``rec`` (applicant_id, job_id, title, company, match_score, skills_match,
    experience_match, rank) by brute force over all applicant x open job pairs."""
    return f"""{_SQL_MODEL},
applied as (select distinct applicant_id, job_id from ats_applications),
p as (select am.applicant_id, jm.job_id, jm.title, jm.company,
             {_SQL_SCORE} as skills_match, {_SQL_EXP} as experience_match
      from am cross join jm left join hits h on h.applicant_id = am.applicant_id and h.job_id = jm.job_id
      where jm.status = 'Open'
        and not exists (select 1 from applied x where x.applicant_id = am.applicant_id and x.job_id = jm.job_id)),
s as (select *, round(skills_match * 0.6 + experience_match * 0.4, 2) as match_score from p),
r as (select *, row_number() over (partition by applicant_id order by match_score desc, job_id) as rank from s),
rec as (select applicant_id, job_id, title, company, match_score, round(skills_match, 6) as skills_match,
       round(experience_match, 6) as experience_match, cast(rank as bigint) as rank from r where rank <= {k})"""


@register("recommend_jobs", sql=f"""
with {sql_recommend_jobs(5)}
select * from rec""")
def q_recommend_jobs(spark, sf_dir, k: int = 5):
    """Top-k open, not-yet-applied jobs per applicant by weighted skill/experience score."""
    return recommend_jobs(Ats(spark, sf_dir), k)


def recommend_jobs(a: Ats, k: int):
    jobs = jobs_model(a).where(F.col("status") == "Open")
    applied = a.ats_application_rows.select("applicant_id", "job_id")
    top = mt.top_k_jobs_by_list(applicant_skills(a), applicant_model(a).select("applicant_id", "years"),
                                jobs.select("job_id", "skills", "req_years"), k, excluded=applied)
    return (top.join(jobs.select(F.col("job_id").alias("item_id"), "title", "company"), "item_id")
               .select(F.col("group_id").alias("applicant_id"), F.col("item_id").alias("job_id"),
                       "title", "company", "match_score",
                       F.round("skills_match", 6).alias("skills_match"),
                       F.round("experience_match", 6).alias("experience_match"), "rank"))


@register("recommend_candidates", sql=f"""
with {_SQL_MODEL},
p as (select jm.job_id, am.applicant_id, am.name,
             {_SQL_SCORE} as skills_match, {_SQL_EXP} as experience_match
      from jm cross join am left join hits h on h.applicant_id = am.applicant_id and h.job_id = jm.job_id),
s as (select *, round(skills_match * 0.6 + experience_match * 0.4, 2) as match_score from p),
r as (select *, row_number() over (partition by job_id order by match_score desc, applicant_id) as rank from s)
select job_id, applicant_id, name, match_score, round(skills_match, 6) as skills_match,
       round(experience_match, 6) as experience_match, cast(rank as bigint) as rank
from r where rank <= 5""")
def q_recommend_candidates(spark, sf_dir, k: int = 5):
    """Top-k applicants per job (every job, every applicant; no status or applied filter)."""
    a = Ats(spark, sf_dir)
    jobs = jobs_model(a)
    top = mt.top_k_applicants_by_list(applicant_skills(a), applicant_model(a).select("applicant_id", "years"),
                                      jobs.select("job_id", "skills", "req_years"), k)
    return (top.join(applicant_model(a).select(F.col("applicant_id").alias("item_id"), "name"), "item_id")
               .select(F.col("group_id").alias("job_id"), F.col("item_id").alias("applicant_id"), "name",
                       "match_score", F.round("skills_match", 6).alias("skills_match"),
                       F.round("experience_match", 6).alias("experience_match"), "rank"))


@register("score_pairs", sql=f"""
with {_SQL_MODEL},
p as (select distinct applicant_id, job_id from ats_applications)
select p.applicant_id, p.job_id, round({_SQL_SCORE}, 6) as skills_match, round({_SQL_EXP}, 6) as experience_match,
       round(({_SQL_SCORE}) * 0.6 + ({_SQL_EXP}) * 0.4, 2) as match_score
from p join jm on jm.job_id = p.job_id join am on am.applicant_id = p.applicant_id
left join hits h on h.applicant_id = p.applicant_id and h.job_id = p.job_id""")
def q_score_pairs(spark, sf_dir):
    """Weighted match score of every applied (applicant, job) pair."""
    a = Ats(spark, sf_dir)
    s = scored_pairs(a, a.ats_application_rows)
    return s.select("applicant_id", "job_id", F.round("skills_match", 6).alias("skills_match"),
                    F.round("experience_match", 6).alias("experience_match"), "match_score")


# Scores of applied pairs, as a CTE named ``sp`` for the oracle.
_SQL_SP = f"""
sp as (select p.applicant_id, p.job_id,
              round(({_SQL_SCORE}) * 0.6 + ({_SQL_EXP}) * 0.4, 2) as match_score
       from (select distinct applicant_id, job_id from ats_applications) p
       join jm on jm.job_id = p.job_id join am on am.applicant_id = p.applicant_id
       left join hits h on h.applicant_id = p.applicant_id and h.job_id = p.job_id)"""


def mean_score(c: str):
    """Mean of 2-decimal scores, summed as exact integer hundredths so the result does
    not depend on the order partial sums are combined in."""
    return F.sum(F.round(F.col(c) * 100).cast("long")) / F.count(c) / 100.0


def application_scores(a: Ats) -> DataFrame:
    """Applications (with ids) and the match score of their (applicant, job) pair."""
    apps = a.ats_applications            # numbered and written once; the pairs are read from there
    s = scored_pairs(a, apps).select("applicant_id", "job_id", "match_score").checkpoint(eager=True)
    release(s.sparkSession)
    return apps.join(s, ["applicant_id", "job_id"])


@register("job_applicants", sql=f"""
with {_SQL_MODEL}, {_SQL_SP}
select x.application_id, x.job_id, x.applicant_id, ap.name, x.status, sp.match_score
from ats_applications x join ats_applicants ap on ap.applicant_id = x.applicant_id
join sp on sp.applicant_id = x.applicant_id and sp.job_id = x.job_id""")
def q_job_applicants(spark, sf_dir):
    """Applicants of every job with their application's match score: a job's rows lie together, by
    score descending, then application."""
    a = Ats(spark, sf_dir)
    apps = application_scores(a)
    return (apps.join(a.ats_applicants.select("applicant_id", "name"), "applicant_id")
                .select("application_id", "job_id", "applicant_id", "name", "status", "match_score")
                .repartition("job_id").sortWithinPartitions("job_id", F.col("match_score").desc(), "application_id"))


@register("applicant_jobs", sql="""
select x.application_id, x.applicant_id, x.job_id, j.title, j.company,
       x.status as application_status, j.status as job_status
from ats_applications x join ats_jobs j on j.job_id = x.job_id""")
def q_applicant_jobs(spark, sf_dir):
    """Jobs each applicant applied to; both sides' status kept under explicit names."""
    a = Ats(spark, sf_dir)
    return (a.ats_applications.withColumnRenamed("status", "application_status")
             .join(a.ats_jobs.select("job_id", "title", "company", F.col("status").alias("job_status")), "job_id")
             .select("application_id", "applicant_id", "job_id", "title", "company",
                     "application_status", "job_status"))


UNAPPLIED_FOR = 7


@register("unapplied_open_jobs", sql=f"""
select j.job_id, j.title, j.company from ats_jobs j
where j.status = 'Open' and j.job_id not in
  (select job_id from ats_applications where applicant_id = {UNAPPLIED_FOR})""")
def q_unapplied_open_jobs(spark, sf_dir, applicant_id: int = UNAPPLIED_FOR):
    """Open jobs one applicant has not applied to (anti join on the applicant's applications)."""
    a = Ats(spark, sf_dir)
    applied = a.ats_application_rows.where(F.col("applicant_id") == applicant_id).select("job_id")
    return (a.ats_jobs.where(F.col("status") == "Open")
             .join(applied, "job_id", "left_anti").select("job_id", "title", "company"))


@register("applications_per_job", sql="""
select j.job_id, j.title, count(x.job_id) as n_applications
from ats_jobs j left join ats_applications x on x.job_id = j.job_id group by j.job_id, j.title""")
def q_applications_per_job(spark, sf_dir):
    """Application count per job, zero for jobs nobody applied to (aggregate, then join)."""
    a = Ats(spark, sf_dir)
    counts = a.ats_application_rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return (a.ats_jobs.select("job_id", "title").join(counts, "job_id", "left")
             .select("job_id", "title", F.coalesce("n", F.lit(0)).cast("long").alias("n_applications")))


@register("status_counts", sql="""
select job_id, status, count(*) as n from ats_applications group by job_id, status""")
def q_status_counts(spark, sf_dir):
    """Value counts of application status per job."""
    a = Ats(spark, sf_dir)
    return a.ats_application_rows.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))


@register("avg_match_score", sql=f"""
with {_SQL_MODEL}, {_SQL_SP},
per_app as (select x.job_id, sp.match_score from ats_applications x
            join sp on sp.applicant_id = x.applicant_id and sp.job_id = x.job_id)
select j.job_id, round(coalesce(sum(cast(round(per_app.match_score * 100) as bigint)) / count(per_app.match_score) / 100.0, 0.0), 6) as avg_match_score
from ats_jobs j left join per_app on per_app.job_id = j.job_id group by j.job_id""")
def q_avg_match_score(spark, sf_dir):
    """Mean match score of each job's applications; 0 for jobs without applications."""
    a = Ats(spark, sf_dir)
    s = scored_pairs(a, a.ats_application_rows).select("applicant_id", "job_id", "match_score")
    per_app = a.ats_application_rows.join(s, ["applicant_id", "job_id"])
    avg = per_app.groupBy("job_id").agg(mean_score("match_score").alias("m"))
    return (a.ats_jobs.select("job_id").join(avg, "job_id", "left")
             .select("job_id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("avg_match_score")))


def _status_summary(apps: DataFrame, key: str) -> DataFrame:
    """"status:n" list per key, most frequent first.  One row per (key, status) is collected,
    and statuses are an enumerated domain (7 values), so the list is bounded."""
    sc = apps.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    lst = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("status"), F.col("n"))))
    return sc.groupBy(key).agg(
        F.array_join(F.transform(lst, lambda s: F.concat(s["status"], F.lit(":"), s["n"].cast("string"))),
                     ", ").alias("status_counts"),
        F.sum("n").alias("total_applications"))


@register("job_report", sql=f"""
with {_SQL_MODEL}, {_SQL_SP},
apps as (select x.application_id, x.job_id, x.applicant_id, x.status, sp.match_score from ats_applications x
         join sp on sp.applicant_id = x.applicant_id and sp.job_id = x.job_id),
sc as (select job_id, status, count(*) as n from apps group by job_id, status),
scs as (select job_id, string_agg(status || ':' || cast(n as varchar), ', ' order by n desc, status) as status_counts
        from sc group by job_id),
agg as (select job_id, count(*) as total_applications,
        sum(cast(round(match_score * 100) as bigint)) / count(match_score) / 100.0 as m from apps group by job_id),
top as (select job_id, applicant_id, row_number() over (partition by job_id order by match_score desc, application_id) as r from apps),
tops as (select job_id, string_agg(cast(applicant_id as varchar), ',' order by r) as top_candidates from top where r <= 5 group by job_id)
select j.job_id, j.title as job_title, cast(j.date_posted as varchar) as date_posted,
       coalesce(agg.total_applications, 0) as total_applications, coalesce(scs.status_counts, '') as status_counts,
       round(coalesce(agg.m, 0.0), 6) as average_match_score, coalesce(tops.top_candidates, '') as top_candidates
from ats_jobs j left join agg on agg.job_id = j.job_id left join scs on scs.job_id = j.job_id
left join tops on tops.job_id = j.job_id""")
def q_job_report(spark, sf_dir, top_n: int = 5):
    """One row per job: application count, status counts, mean score, top-n applicants."""
    a = Ats(spark, sf_dir)
    apps = application_scores(a).checkpoint(eager=True)
    summary = _status_summary(apps, "job_id")
    mean = apps.groupBy("job_id").agg(mean_score("match_score").alias("m"))
    top = top_k_per(apps, ["job_id"], [F.col("match_score").desc(), F.col("application_id")], top_n, "r")
    tops = top.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("r", "applicant_id"))).alias("t")).select(
        "job_id", F.array_join(F.transform("t", lambda s: s["applicant_id"].cast("string")), ",").alias("top_candidates"))
    return (a.ats_jobs.select("job_id", F.col("title").alias("job_title"),
                              F.col("date_posted").cast("string").alias("date_posted"))
             .join(summary, "job_id", "left").join(mean, "job_id", "left").join(tops, "job_id", "left")
             .select("job_id", "job_title", "date_posted",
                     F.coalesce("total_applications", F.lit(0)).cast("long").alias("total_applications"),
                     F.coalesce("status_counts", F.lit("")).alias("status_counts"),
                     F.round(F.coalesce("m", F.lit(0.0)), 6).alias("average_match_score"),
                     F.coalesce("top_candidates", F.lit("")).alias("top_candidates")))


@register("applicant_report", sql=f"""
with {sql_recommend_jobs(3)}, {_SQL_SP},
apps as (select x.application_id, x.applicant_id, x.status, sp.match_score from ats_applications x
         join sp on sp.applicant_id = x.applicant_id and sp.job_id = x.job_id),
sc as (select applicant_id, status, count(*) as n from apps group by applicant_id, status),
scs as (select applicant_id, string_agg(status || ':' || cast(n as varchar), ', ' order by n desc, status) as status_counts
        from sc group by applicant_id),
agg as (select applicant_id, count(*) as total_applications,
        sum(cast(round(match_score * 100) as bigint)) / count(match_score) / 100.0 as m from apps group by applicant_id),
recs as (select applicant_id, string_agg(cast(job_id as varchar), ',' order by rank) as recommended_jobs
         from rec group by applicant_id)
select ap.applicant_id, ap.name as applicant_name, coalesce(agg.total_applications, 0) as total_applications,
       coalesce(scs.status_counts, '') as status_counts, round(coalesce(agg.m, 0.0), 6) as average_match_score,
       coalesce(recs.recommended_jobs, '') as recommended_jobs
from ats_applicants ap left join agg using (applicant_id) left join scs using (applicant_id)
left join recs using (applicant_id)""")
def q_applicant_report(spark, sf_dir, k: int = 3):
    """One row per applicant: application count, status counts, mean score, top-k job picks."""
    a = Ats(spark, sf_dir)
    apps = application_scores(a)
    summary = _status_summary(apps, "applicant_id")
    mean = apps.groupBy("applicant_id").agg(mean_score("match_score").alias("m"))
    rec = recommend_jobs(a, k)
    release(spark)                      # what the ids and the recommendations shuffled, before the report does
    recs = rec.groupBy("applicant_id").agg(F.array_sort(F.collect_list(F.struct("rank", "job_id"))).alias("t")).select(
        "applicant_id", F.array_join(F.transform("t", lambda s: s["job_id"].cast("string")), ",").alias("recommended_jobs"))
    return (a.ats_applicants.select("applicant_id", F.col("name").alias("applicant_name"))
             .join(summary, "applicant_id", "left").join(mean, "applicant_id", "left").join(recs, "applicant_id", "left")
             .select("applicant_id", "applicant_name",
                     F.coalesce("total_applications", F.lit(0)).cast("long").alias("total_applications"),
                     F.coalesce("status_counts", F.lit("")).alias("status_counts"),
                     F.round(F.coalesce("m", F.lit(0.0)), 6).alias("average_match_score"),
                     F.coalesce("recommended_jobs", F.lit("")).alias("recommended_jobs")))


SEARCH_KEYWORDS, SEARCH_LOC, SEARCH_DEPT = "blue (anvil|gear)", "nation_1[0-5]", "sma|pro"


def search_jobs(jobs, keywords: str | None, location: str | None = None, department: str | None = None):
    """Case-insensitive regex 'contains' filters; only given filters apply; null never matches.
    The keyword matches title, description or a string skills field."""
    def has(c, p):
        return F.coalesce(F.col(c).rlike("(?i)" + p), F.lit(False))
    if location:
        jobs = jobs.where(has("location", location))
    if department:
        jobs = jobs.where(has("department", department))
    if keywords:
        jobs = jobs.where(has("title", keywords) | has("description", keywords) | has("skills_required", keywords))
    return jobs


@register("search_regex", sql=f"""
select j.job_id, j.title, j.location, j.department from ats_jobs j join ats_postings p on p.job_id = j.job_id
where coalesce(regexp_matches(j.location, '{SEARCH_LOC}', 'i'), false)
  and coalesce(regexp_matches(j.department, '{SEARCH_DEPT}', 'i'), false)
  and (coalesce(regexp_matches(j.title, '{SEARCH_KEYWORDS}', 'i'), false)
       or coalesce(regexp_matches(p.text, '{SEARCH_KEYWORDS}', 'i'), false)
       or coalesce(regexp_matches(j.skills_required, '{SEARCH_KEYWORDS}', 'i'), false))""")
def q_search_regex(spark, sf_dir, keywords: str = SEARCH_KEYWORDS, location: str = SEARCH_LOC,
                   department: str = SEARCH_DEPT):
    """Job search by keyword / location / department regular expressions."""
    a = Ats(spark, sf_dir)
    jobs = a.ats_jobs.join(a.ats_postings.withColumnRenamed("text", "description"), "job_id")
    return search_jobs(jobs, keywords, location, department).select("job_id", "title", "location", "department")


def apply_requests(a: Ats):
    """Apply clicks: each event asks to apply ``user_id`` to job ``event_id``."""
    return a.events.select("event_id", F.col("user_id").alias("applicant_id"),
                           F.col("event_id").alias("job_id"), "ts")


def check_refs(req, jobs, applicants):
    """Reason per request: unknown job first, then unknown applicant, else 'ok'."""
    jk = jobs.select("job_id", F.lit(True).alias("_job"))
    ak = applicants.select("applicant_id", F.lit(True).alias("_app"))
    return (req.join(jk, "job_id", "left").join(ak, "applicant_id", "left")
               .withColumn("reason", F.when(F.col("_job").isNull(), "unknown_job")
                           .when(F.col("_app").isNull(), "unknown_applicant").otherwise("ok"))
               .drop("_job", "_app"))


@register("reject_unknown_refs", sql="""
select e.event_id, e.user_id as applicant_id, e.event_id as job_id,
       case when j.job_id is null then 'unknown_job' when ap.applicant_id is null then 'unknown_applicant' else 'ok' end as reason
from events e left join ats_jobs j on j.job_id = e.event_id left join ats_applicants ap on ap.applicant_id = e.user_id""")
def q_reject_unknown_refs(spark, sf_dir):
    """Referential check of apply requests against jobs and applicants (left joins, reason column)."""
    a = Ats(spark, sf_dir)
    return check_refs(apply_requests(a), a.ats_jobs, a.ats_applicants).select(
        "event_id", "applicant_id", "job_id", "reason")


@register("apply_batch", sql=f"""
with {_SQL_MODEL}, ok as (
  select e.event_id, e.user_id as applicant_id, e.event_id as job_id, e.ts from events e
  where e.event_id in (select job_id from ats_jobs) and e.user_id in (select applicant_id from ats_applicants)),
n0 as (select count(*) as n from ats_applications),
sc as (select ok.applicant_id, ok.job_id,
              round(({_SQL_SCORE}) * 0.6 + ({_SQL_EXP}) * 0.4, 2) as match_score
       from (select distinct applicant_id, job_id from ok) ok join jm on jm.job_id = ok.job_id
       join am on am.applicant_id = ok.applicant_id
       left join hits h on h.applicant_id = ok.applicant_id and h.job_id = ok.job_id)
select 'APP-' || cast(n0.n + row_number() over (order by ok.event_id) as varchar) as application_id,
       ok.applicant_id, ok.job_id, strftime(ok.ts, '%Y-%m-%d') as date_applied, 'Applied' as status,
       sc.match_score
from ok join sc using (applicant_id, job_id), n0""")
def q_apply_batch(spark, sf_dir):
    """Valid apply requests become applications: sequential id after the existing count,
    request date, status 'Applied' and the computed match score."""
    a = Ats(spark, sf_dir)
    req = check_refs(apply_requests(a), a.ats_jobs, a.ats_applicants).where(F.col("reason") == "ok")
    n0 = a.ats_application_rows.count()
    ids = with_sequence(req, ["event_id"], "seq", start=n0 + 1)
    scores = scored_pairs(a, req.select("applicant_id", "job_id")).select("applicant_id", "job_id", "match_score")
    return (ids.join(scores, ["applicant_id", "job_id"])
               .select(F.concat(F.lit("APP-"), F.col("seq").cast("string")).alias("application_id"),
                       "applicant_id", "job_id", F.date_format("ts", "yyyy-MM-dd").alias("date_applied"),
                       F.lit("Applied").alias("status"), "match_score"))


PROMOTIONS = {"Interview": "Offer", "Offer": "Hired", "Screening": "Shortlisted"}


@register("update_status", sql="""
with u0 as (select application_id, case status when 'Interview' then 'Offer' when 'Offer' then 'Hired'
                                         when 'Screening' then 'Shortlisted' end as new_status, 0 as seq
           from ats_applications where status in ('Interview', 'Offer', 'Screening')
  union all select application_id, 'Rejected', 1 from ats_applications where status = 'Interview' and application_id % 5 = 0
  union all select application_id + 1000000000, 'Hired', 0 from ats_applications where application_id % 100 = 0),
u as (select application_id, arg_max(new_status, seq) as new_status from u0 group by application_id)
select coalesce(x.application_id, u.application_id) as application_id, x.status as old_status,
       case when x.application_id is not null and u.new_status in ('Applied', 'Screening', 'Interview', 'Technical Test', 'Offer', 'Hired', 'Rejected')
            then u.new_status else x.status end as status,
       case when x.application_id is null then 'unknown_application' when u.new_status is null then 'unchanged'
            when u.new_status in ('Applied', 'Screening', 'Interview', 'Technical Test', 'Offer', 'Hired', 'Rejected')
            then 'updated' else 'invalid_status' end as result
from ats_applications x full join u on u.application_id = x.application_id""")
def q_update_status(spark, sf_dir):
    """Apply a batch of status changes (promotions, some overruled by a later rejection, some for
    applications that do not exist); unknown statuses and unknown ids are refused."""
    a = Ats(spark, sf_dir)
    apps = a.ats_applications
    m = F.create_map(*[F.lit(x) for kv in PROMOTIONS.items() for x in kv])
    updates = (apps.where(F.col("status").isin(*PROMOTIONS)).select("application_id", m[F.col("status")].alias("new_status"), F.lit(0).alias("seq"))
               .unionByName(apps.where("status = 'Interview' and application_id % 5 = 0").select(
                   "application_id", F.lit("Rejected").alias("new_status"), F.lit(1).alias("seq")))
               .unionByName(apps.where("application_id % 100 = 0").select(
                   (F.col("application_id") + 1_000_000_000).alias("application_id"), F.lit("Hired").alias("new_status"), F.lit(0).alias("seq"))))
    return update_statuses(apps, updates)


def update_statuses(apps, updates):
    """Last update per id (by seq) against the applications: a valid new status replaces the old one;
    invalid statuses and unknown ids are reported, not applied."""
    updates = last_wins(updates, ["application_id"], "seq").select("application_id", "new_status")
    valid, known = F.col("new_status").isin(*cat.APPLICATION_STATUSES), F.col("_known").isNotNull()
    return (apps.withColumn("_known", F.lit(True)).join(updates, "application_id", "full")
                .select("application_id", F.col("status").alias("old_status"),
                        F.when(known & valid, F.col("new_status")).otherwise(F.col("status")).alias("status"),
                        F.when(~known, "unknown_application").when(F.col("new_status").isNull(), "unchanged").when(valid, "updated")
                         .otherwise("invalid_status").alias("result")))


@register("assign_ids", sql="""
select applicant_id, printf('APP%03d', row_number() over (order by name, applicant_id)) as applicant_code
from ats_applicants""")
def q_assign_ids(spark, sf_dir):
    """Sequential codes APP001, APP002, ... in name order (distributed numbering)."""
    a = Ats(spark, sf_dir)
    s = with_sequence(a.ats_applicants.select("applicant_id", "name"), ["name", "applicant_id"], "n")
    return s.select("applicant_id", F.format_string("APP%03d", F.col("n")).alias("applicant_code"))


SPLIT_DAY = "1998-01-01"


@register("dedupe_applications", sql=f"""
with existing as (select distinct applicant_id, job_id from ats_applications where applied_date < timestamp '{SPLIT_DAY}'),
batch as (select *, row_number() over (partition by applicant_id, job_id order by application_id) as r
          from ats_applications where applied_date >= timestamp '{SPLIT_DAY}')
select b.application_id, b.applicant_id, b.job_id from batch b
where r = 1 and not exists (select 1 from existing e where e.applicant_id = b.applicant_id and e.job_id = b.job_id)""")
def q_dedupe_applications(spark, sf_dir, split_day: str = SPLIT_DAY):
    """Applications from ``split_day`` on are a new batch: a (user, job) pair already applied to,
    or repeated inside the batch, is refused (first per pair wins)."""
    a = Ats(spark, sf_dir)
    apps = a.ats_applications
    cut = F.lit(split_day).cast("timestamp_ntz")
    existing = apps.where(F.col("applied_date") < cut).select("applicant_id", "job_id").distinct()
    batch = first_wins(apps.where(F.col("applied_date") >= cut), ["applicant_id", "job_id"],
                       [F.col("application_id")])
    return (batch.join(existing, ["applicant_id", "job_id"], "left_anti")
                 .select("application_id", "applicant_id", "job_id"))


@register("unique_violations", sql="""
select 'job_key' as entity, company || ',' || title as key, count(*) as n from ats_jobs group by 2 having count(*) > 1
union all
select 'application_pair', cast(applicant_id as varchar) || ',' || cast(job_id as varchar), count(*)
from ats_applications group by 2 having count(*) > 1""")
def q_unique_violations(spark, sf_dir):
    """Keys that should be unique but are not (aggregate, keep count > 1)."""
    a = Ats(spark, sf_dir)
    jk = (a.ats_jobs.groupBy(F.concat_ws(",", "company", "title").alias("key"))
           .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("job_key").alias("entity"), "key", "n"))
    ak = (a.ats_application_rows
           .groupBy(F.concat_ws(",", F.col("applicant_id").cast("string"), F.col("job_id").cast("string")).alias("key"))
           .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("application_pair").alias("entity"), "key", "n"))
    return jk.unionByName(ak)


AS_OF_DATE = "2024-03-01"


@register("append_with_defaults", sql=f"""
with hp as (select hit_id, json_extract_string(json, '$.hit.title') as title,
                   json_extract_string(json, '$.hit.company.name') as company,
                   case when coalesce(json_array_length(json, '$.hit.locations'), 0) = 0 then ''
                        else json_extract_string(json, '$.hit.locations[0].country') || ',' ||
                             json_extract_string(json, '$.hit.locations[0].address') end as location from ats_hits)
select 'job-' || cast(job_id as varchar) as job_key, title, company, location, status, is_full_time,
       cast(date_posted as varchar) as date_posted from ats_jobs
union all
select 'hit-' || cast(hit_id as varchar), title, company, location, 'Open', true, '{AS_OF_DATE}' from hp""")
def q_append_with_defaults(spark, sf_dir, as_of: str = AS_OF_DATE):
    """Append newly seen postings to the jobs table; missing columns take their defaults
    (status Open, full time, posted on ``as_of``)."""
    from ..sources import ingest as ig
    a = Ats(spark, sf_dir)
    jobs = a.ats_jobs.select(F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("job_key"),
                             "title", "company", "location", "status", "is_full_time",
                             F.col("date_posted").cast("string").alias("date_posted"))
    h = ig.project_hits(ig.parse_hits(a.ats_hits), "")
    new = h.select(F.concat(F.lit("hit-"), F.col("hit_id").cast("string")).alias("job_key"),
                   "title", F.col("name").alias("company"), "location")
    return jobs.unionByName(with_job_defaults(new, as_of))


def with_job_defaults(df, as_of: str):
    return (df.withColumn("status", F.lit("Open")).withColumn("is_full_time", F.lit(True))
              .withColumn("date_posted", F.lit(as_of)))


@register("parse_years", sql=f"""
with {_SQL_MODEL}
select 'job' as entity, job_id as id, experience_required as text, req_years as years from jm
union all select 'applicant', ap.applicant_id, ap.experience, am.years
from ats_applicants ap join am using (applicant_id)""")
def q_parse_years(spark, sf_dir):
    """Leading number of free-text experience ('6 years' -> 6; '5+ years', '5-10 years' -> null)."""
    a = Ats(spark, sf_dir)
    j = a.ats_jobs.select(F.lit("job").alias("entity"), F.col("job_id").alias("id"),
                          F.col("experience_required").alias("text"))
    ap = a.ats_applicants.select(F.lit("applicant").alias("entity"), F.col("applicant_id").alias("id"),
                                 F.col("experience").alias("text"))
    return j.unionByName(ap).withColumn("years", parse_years("text"))


@register("experience_match_pct", sql=f"""
with {_SQL_MODEL}
select p.applicant_id, p.job_id, round({_SQL_EXP}, 6) as experience_match
from (select distinct applicant_id, job_id from ats_applications) p
join jm on jm.job_id = p.job_id join am on am.applicant_id = p.applicant_id""")
def q_experience_match_pct(spark, sf_dir):
    """Experience fit of every applied pair (100 if met, ratio otherwise, 50 if unparseable)."""
    a = Ats(spark, sf_dir)
    s = scored_pairs(a, a.ats_application_rows)
    return s.select("applicant_id", "job_id", F.round("experience_match", 6).alias("experience_match"))


@register("skill_match_pct", sql=f"""
with {_SQL_MODEL}
select p.applicant_id, p.job_id, round({_SQL_SCORE}, 6) as skills_match
from (select distinct applicant_id, job_id from ats_applications) p
join jm on jm.job_id = p.job_id left join hits h on h.applicant_id = p.applicant_id and h.job_id = p.job_id""")
def q_skill_match_pct(spark, sf_dir):
    """Skill fit of every applied pair: job skills contained in / containing an applicant skill."""
    a = Ats(spark, sf_dir)
    s = scored_pairs(a, a.ats_application_rows)
    return s.select("applicant_id", "job_id", F.round("skills_match", 6).alias("skills_match"))


@register("last_wins", sql="""
with r as (select applicant_id, job_id, application_id, status,
                  row_number() over (partition by applicant_id, job_id order by application_id desc) as rn
           from ats_applications)
select applicant_id, job_id, application_id as last_application_id, status from r where rn = 1""")
def q_last_wins(spark, sf_dir):
    """Last write per key: the most recent application (highest id) of each (applicant, job)."""
    a = Ats(spark, sf_dir)
    lw = last_wins(a.ats_applications, ["applicant_id", "job_id"], "application_id")
    return lw.select("applicant_id", "job_id", F.col("application_id").alias("last_application_id"), "status")


@register("unapplied_open_counts", sql="""
with open_jobs as (select job_id from ats_jobs where status = 'Open'),
applied as (select x.applicant_id, count(distinct x.job_id) as n from ats_applications x
            where x.job_id in (select job_id from open_jobs) group by x.applicant_id)
select ap.applicant_id, (select count(*) from open_jobs) - coalesce(applied.n, 0) as n_unapplied_open
from ats_applicants ap left join applied using (applicant_id)""")
def q_unapplied_open_counts(spark, sf_dir):
    """For every applicant, how many open jobs they have not applied to: open-job count minus
    the distinct open jobs in their applications (no applicant x job pairs are formed)."""
    a = Ats(spark, sf_dir)
    open_jobs = a.ats_jobs.where(F.col("status") == "Open").select("job_id")
    n_open = open_jobs.count()
    applied = (a.ats_application_rows.select("applicant_id", "job_id").join(open_jobs, "job_id", "left_semi")
                .groupBy("applicant_id").agg(F.count_distinct("job_id").alias("n")))
    return (a.ats_applicants.select("applicant_id").join(applied, "applicant_id", "left")
             .select("applicant_id", (F.lit(n_open) - F.coalesce("n", F.lit(0))).cast("long").alias("n_unapplied_open")))
