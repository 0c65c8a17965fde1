"""Queries over the job-board model: users, skills, jobs, job skills, applications."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scoring import levenshtein_ratio
from ..operators import fuzzy as fz
from ..operators import overlap as ov
from ..operators import search as se
from ..operators.sequence import with_sequence
from ..operators.topk import first_wins, top_k_per
from ..session import shared_dir
from ..sources import keyed
from ..sources.fixtures import Ats
from .registry import register


# every user with every job, 0 % where no skill is shared (the detail page shows such jobs too)
_SQL_OVERLAP = """
js as (select distinct job_id, skill_id from ats_job_skill),
den as (select job_id, count(*) as n_job_skills from js group by job_id),
hits as (select u.user_id, js.job_id, count(*) as n_common
         from ats_user_skill u join js on u.skill_id = js.skill_id group by u.user_id, js.job_id),
p as (select ap.applicant_id as user_id, j.job_id, coalesce(h.n_common, 0) as n_common,
             coalesce(d.n_job_skills, 0) as n_job_skills,
             coalesce(cast(coalesce(h.n_common, 0) as double) / d.n_job_skills * 100.0, 0.0) as overlap_pct
      from ats_applicants ap cross join ats_jobs j left join den d on d.job_id = j.job_id
      left join hits h on h.user_id = ap.applicant_id and h.job_id = j.job_id)"""


def users(a: Ats):
    return a.ats_applicants.select(F.col("applicant_id").alias("user_id"))


@register("overlap_distinct", sql=f"""
with {_SQL_OVERLAP},
r as (select *, row_number() over (partition by user_id order by overlap_pct desc, job_id) as rank from p)
select user_id, job_id, n_common, n_job_skills, round(overlap_pct, 6) as overlap_pct,
       case when overlap_pct >= 70 then 'Strong Match' when overlap_pct >= 40 then 'Medium Match' else 'Weak Match' end as bucket,
       cast(rank as bigint) as rank
from r where rank <= 5""")
def q_overlap_distinct(spark, sf_dir, k: int = 5):
    """Which jobs suit each user: top-k jobs by distinct skill overlap, with the match bucket."""
    a = Ats(spark, sf_dir)
    top = ov.top_overlap(users(a), a.ats_jobs, a.ats_user_skill, a.ats_job_skill, k)
    return top.select("user_id", "job_id", "n_common", "n_job_skills",
                      F.round("overlap_pct", 6).alias("overlap_pct"),
                      ov.match_bucket(F.col("overlap_pct")).alias("bucket"), "rank")


# Board "skills" are the supplier rows the job/user skill bridges point at.
def skills_table(a: Ats):
    return a.supplier.select(F.col("s_suppkey").alias("skill_id"), F.col("s_name").alias("name"))


@register("overlap_apply", sql="""
with p as (select distinct applicant_id as user_id, job_id from ats_applications),
jsd as (select distinct job_id, skill_id from ats_job_skill),
den as (select job_id, count(*) as n from ats_job_skill group by job_id),
c as (select p.user_id, p.job_id, count(*) as n_common from p join jsd on jsd.job_id = p.job_id
      join ats_user_skill u on u.user_id = p.user_id and u.skill_id = jsd.skill_id group by p.user_id, p.job_id)
select p.user_id, p.job_id,
       round(coalesce(cast(coalesce(c.n_common, 0) as double) / den.n * 100.0, 0.0), 6) as overlap_pct
from p left join den on den.job_id = p.job_id left join c on c.user_id = p.user_id and c.job_id = p.job_id""")
def q_overlap_apply(spark, sf_dir):
    """Apply-time match % of every application: distinct common skills over the raw job list."""
    a = Ats(spark, sf_dir)
    pairs = a.ats_application_rows.select(F.col("applicant_id").alias("user_id"), "job_id")
    r = ov.overlap_apply(pairs, a.ats_user_skill, a.ats_job_skill)
    return r.select("user_id", "job_id", F.round("overlap_pct", 6).alias("overlap_pct"))


LATEST_N = 20


def latest_jobs(a: Ats, n: int = LATEST_N):
    return a.ats_jobs.orderBy(F.col("date_posted").desc(), F.col("job_id")).limit(n)


_SQL_LATEST = f"""latest as (select * from ats_jobs order by date_posted desc, job_id limit {LATEST_N})"""


@register("latest_jobs", sql=f"""
with {_SQL_LATEST}
select job_id, title, company, location, cast(date_posted as varchar) as date_posted,
       case when is_full_time then 'Full Time' else 'Part Time' end as job_type from latest""")
def q_latest_jobs(spark, sf_dir, n: int = LATEST_N):
    """Newest n jobs (TakeOrderedAndProject) with the full/part-time label."""
    a = Ats(spark, sf_dir)
    return latest_jobs(a, n).select(
        "job_id", "title", "company", "location", F.col("date_posted").cast("string").alias("date_posted"),
        F.when(F.col("is_full_time"), "Full Time").otherwise("Part Time").alias("job_type"))


@register("overlap_card", sql=f"""
with {_SQL_LATEST},
js as (select s.job_id, s.skill_id from ats_job_skill s join latest l on l.job_id = s.job_id),
den as (select job_id, count(*) as n from js group by job_id),
hits as (select u.user_id, d.job_id, count(*) as n_hit
         from ats_user_skill u join (select distinct job_id, skill_id from js) d on d.skill_id = u.skill_id
         group by u.user_id, d.job_id),
p as (select ap.applicant_id as user_id, l.job_id, coalesce(cast(coalesce(h.n_hit, 0) as double) / den.n * 100.0, 0.0) as pct
      from ats_applicants ap cross join latest l left join den on den.job_id = l.job_id
      left join hits h on h.user_id = ap.applicant_id and h.job_id = l.job_id)
select user_id, job_id, round(pct, 6) as overlap_pct,
       case when pct >= 70 then 'Strong Match' when pct >= 40 then 'Medium Match' else 'Weak Match' end as bucket
from p""")
def q_overlap_card(spark, sf_dir):
    """Match % and label on the cards of the newest jobs for every user (0 % / Weak Match included)."""
    a = Ats(spark, sf_dir)
    r = ov.overlap_card(users(a), latest_jobs(a), a.ats_user_skill, a.ats_job_skill)
    return r.select("user_id", "job_id", F.round("overlap_pct", 6).alias("overlap_pct"),
                    ov.match_bucket(F.col("overlap_pct")).alias("bucket"))


@register("match_bucket", sql=f"""
with {_SQL_OVERLAP}
select user_id, case when overlap_pct >= 70 then 'Strong Match' when overlap_pct >= 40 then 'Medium Match' else 'Weak Match' end as bucket,
       count(*) as n_jobs
from p group by 1, 2""")
def q_match_bucket(spark, sf_dir):
    """How many of all jobs fall in each match label, for every user."""
    a = Ats(spark, sf_dir)
    return ov.bucket_counts(users(a), a.ats_jobs, a.ats_user_skill, a.ats_job_skill)


@register("skill_overlap", sql=f"""
with {_SQL_OVERLAP}
select user_id, cast(sum(case when n_common > 0 then 1 else 0 end) as bigint) as n_jobs_sharing,
       cast(sum(n_common) as bigint) as n_common_total, max(n_common) as max_common
from p group by user_id""")
def q_skill_overlap(spark, sf_dir):
    """Jobs sharing a skill with each user, common skills in all and at most, for every user."""
    a = Ats(spark, sf_dir)
    return ov.shared_counts(users(a), a.ats_user_skill, a.ats_job_skill)


@register("job_skill_names", sql="""
select s.job_id, s.skill_id, k.s_name as skill_name, count(*) as n_listed
from ats_job_skill s join supplier k on k.s_suppkey = s.skill_id group by s.job_id, s.skill_id, k.s_name""")
def q_job_skill_names(spark, sf_dir):
    """Bridge join job - job_skill - skill in long form: each distinct skill of a job with its
    name and how often the raw list names it (cards show the raw list, details the set)."""
    a = Ats(spark, sf_dir)
    js = a.ats_job_skill.groupBy("job_id", "skill_id").agg(F.count(F.lit(1)).alias("n_listed"))
    return js.join(skills_table(a), "skill_id").select(
        "job_id", "skill_id", F.col("name").alias("skill_name"), "n_listed")


@register("skill_tags", sql="""
select job_id, array_to_string(list_slice(string_split(skills_required, ' '), 1, 5), ', ') as tags,
       greatest(len(string_split(skills_required, ' ')) - 5, 0) as n_more,
       array_to_string(list_slice(string_split(skills_required, ' '), 1, 10), ', ') as top_skills
from ats_jobs""")
def q_skill_tags(spark, sf_dir):
    """First five skill tags and the "+k more" count; first ten as the posting's top skills."""
    a = Ats(spark, sf_dir)
    lst = F.split(F.col("skills_required"), " ", -1)
    return a.ats_jobs.select("job_id", F.array_join(F.slice(lst, 1, 5), ", ").alias("tags"),
                             F.greatest(F.size(lst) - 5, F.lit(0)).cast("long").alias("n_more"),
                             F.array_join(F.slice(lst, 1, 10), ", ").alias("top_skills"))


@register("job_view_flags", sql="""
with firsts as (select applicant_id, job_id, application_id, applied_date, status,
                row_number() over (partition by applicant_id, job_id order by application_id) as r from ats_applications),
f as (select * from firsts where r = 1),
js as (select distinct job_id, skill_id from ats_job_skill),
chk as (select f.applicant_id, f.job_id, count(js.skill_id) as n_job_skills, count(u.skill_id) as n_checked
        from f join js on js.job_id = f.job_id
        left join ats_user_skill u on u.user_id = f.applicant_id and u.skill_id = js.skill_id
        group by f.applicant_id, f.job_id)
select f.applicant_id, f.job_id, f.application_id as first_application_id,
       strftime(f.applied_date, '%b %d, %Y') as applied_on, chk.n_job_skills, chk.n_checked
from f join chk on chk.applicant_id = f.applicant_id and chk.job_id = f.job_id""")
def q_job_view_flags(spark, sf_dir):
    """Job page flags per (user, job) the user applied to: first application and its date
    ("Applied on ..."), and how many of the job's skills carry the user's check mark."""
    a = Ats(spark, sf_dir)
    apps = a.ats_applications.select(F.col("applicant_id").alias("user_id"), "job_id", "application_id", "applied_date")
    f = first_wins(apps, ["user_id", "job_id"], [F.col("application_id")])
    chk = ov.with_shared_skills(f.where("user_id is not null"), a.ats_user_skill, a.ats_job_skill).where("n_listed is not null")
    return chk.select(
        F.col("user_id").alias("applicant_id"), "job_id", F.col("application_id").alias("first_application_id"),
        F.date_format("applied_date", "MMM dd, yyyy").alias("applied_on"), F.col("n_distinct").alias("n_job_skills"),
        F.size("shared").cast("long").alias("n_checked"))


@register("profile_applications", sql="""
with den as (select job_id, count(*) as n from ats_job_skill group by job_id),
jsd as (select distinct job_id, skill_id from ats_job_skill),
c as (select x.application_id, count(u.skill_id) as n_common from ats_applications x
      join jsd on jsd.job_id = x.job_id
      left join ats_user_skill u on u.user_id = x.applicant_id and u.skill_id = jsd.skill_id
      group by x.application_id)
select x.application_id, x.applicant_id, j.title, j.company, j.location,
       strftime(x.applied_date, '%b %d, %Y') as applied_on,
       cast(floor(coalesce(cast(c.n_common as double) / den.n * 100.0, 0.0)) as bigint) as match_int,
       x.status
from ats_applications x join ats_jobs j on j.job_id = x.job_id
left join den on den.job_id = x.job_id left join c on c.application_id = x.application_id""")
def q_profile_applications(spark, sf_dir):
    """A user's applications as the profile page lists them: job, date, integer %, status."""
    a = Ats(spark, sf_dir)
    apps = a.ats_applications.withColumnRenamed("applicant_id", "user_id")
    pairs = ov.with_shared_skills(apps, a.ats_user_skill, a.ats_job_skill)
    return (pairs.join(a.ats_jobs.select("job_id", "title", "company", "location"), "job_id")
                 .select("application_id", F.col("user_id").alias("applicant_id"), "title", "company", "location",
                         F.date_format("applied_date", "MMM dd, yyyy").alias("applied_on"),
                         F.floor(ov.listed_pct(F.col("shared"), F.col("n_listed"))).cast("long").alias("match_int"),
                         "status"))


SEARCH_Q, SEARCH_LOCATION = "blue", "nation_1"


def board_search(a: Ats, q: str, location: str):
    """LIKE '%q%' on title or description, and on location; empty parameters do not filter.
    SQLite LIKE is case-insensitive for ASCII, hence ilike; % and _ in input stay wildcards."""
    jobs = a.ats_jobs.join(a.ats_postings.withColumnRenamed("text", "description"), "job_id")
    if q:
        pat = f"%{q}%"
        jobs = jobs.where(F.col("title").ilike(pat) | F.col("description").ilike(pat))
    if location:
        jobs = jobs.where(F.col("location").ilike(f"%{location}%"))
    return jobs


@register("search_like", sql=f"""
select j.job_id, j.title, j.location, cast(j.date_posted as varchar) as date_posted
from ats_jobs j join ats_postings p on p.job_id = j.job_id
where (j.title ilike '%{SEARCH_Q}%' or p.text ilike '%{SEARCH_Q}%') and j.location ilike '%{SEARCH_LOCATION}%'""")
def q_search_like(spark, sf_dir, q: str = SEARCH_Q, location: str = SEARCH_LOCATION):
    """Board search, newest first."""
    a = Ats(spark, sf_dir)
    return (board_search(a, q, location)
            .select("job_id", "title", "location", F.col("date_posted").cast("string").alias("date_posted"))
            .orderBy(F.col("date_posted").desc(), F.col("job_id")))


@register("search_count", sql=f"""
select count(*) as n_results
from ats_jobs j join ats_postings p on p.job_id = j.job_id
where (j.title ilike '%{SEARCH_Q}%' or p.text ilike '%{SEARCH_Q}%') and j.location ilike '%{SEARCH_LOCATION}%'""")
def q_search_count(spark, sf_dir, q: str = SEARCH_Q, location: str = SEARCH_LOCATION):
    """Number of search hits."""
    a = Ats(spark, sf_dir)
    return board_search(a, q, location).agg(F.count(F.lit(1)).alias("n_results"))


def stored_searches(a: Ats):
    """A stored search of every job seeker: a word of a posting's title or a part of it, some with a wildcard."""
    k, title = F.col("job_id"), F.col("title")
    part = F.substring(title, (k % 5 + 1).cast("int"), (k % 9 + 1).cast("int"))
    q = F.when(k % 3 == 0, F.regexp_replace(part, "a", "_")).when(k % 3 == 1, F.concat(part, F.lit("%"), F.upper("company"))).otherwise(part)
    return a.ats_jobs.select(k.alias("search_id"), q.alias("q"))


_SQL_SEARCHES = """
sr as (select job_id as search_id, case when job_id % 3 = 0 then replace(p, 'a', '_') when job_id % 3 = 1 then p || '%' || upper(company) else p end as q
       from (select job_id, company, substr(title, cast(job_id % 5 + 1 as int), cast(job_id % 9 + 1 as int)) as p from ats_jobs)),
tx as (select j.job_id as id, j.title || ' ' || j.company || ' ' || j.location as text from ats_jobs j)"""


def search_texts(a: Ats):
    return a.ats_jobs.select(F.col("job_id").alias("id"), F.concat_ws(" ", "title", "company", "location").alias("text"))


@register("stored_searches_like", sql=f"""
with {_SQL_SEARCHES}
select search_id, count(id) as n_hits, min(id) as first_id
from sr left join tx on text ilike '%' || q || '%' group by search_id""")
def q_stored_searches_like(spark, sf_dir):
    """Hits of all stored LIKE searches over all jobs, by their rarest three characters."""
    a = Ats(spark, sf_dir)
    searches = stored_searches(a)
    return se.hits_per_search(searches, search_texts(a), se.search_like)


@register("stored_searches_regex", sql="""
with sr as (select job_id as search_id, case when job_id % 4 = 0 then split_part(title, ' ', 1) || '|' || split_part(title, ' ', 2)
                   when job_id % 4 = 1 then split_part(title, ' ', 1) || '.*' || substr(company, 1, 6) || '[0-5]' || '$'
                   when job_id % 4 = 2 then '(' || split_part(title, ' ', 2) || '|nothing) brand#?' || cast(job_id % 30 as varchar)
                   else '^' || substr(title, 1, 5) || 'x*' end as q from ats_jobs),
tx as (select job_id as id, title || ' ' || company as text from ats_jobs)
select search_id, count(id) as n_hits, min(id) as first_id from sr left join tx on regexp_matches(text, q, 'i') group by search_id""")
def q_stored_searches_regex(spark, sf_dir):
    """Hits of all stored regular expressions over all jobs, by their rarest three characters."""
    a = Ats(spark, sf_dir)
    k, word = F.col("job_id"), lambda n: F.split_part("title", F.lit(" "), F.lit(n))
    q = (F.when(k % 4 == 0, F.concat(word(1), F.lit("|"), word(2)))
         .when(k % 4 == 1, F.concat(word(1), F.lit(".*"), F.substring("company", 1, 6), F.lit("[0-5]$")))
         .when(k % 4 == 2, F.concat(F.lit("("), word(2), F.lit("|nothing) brand#?"), (k % 30).cast("string")))
         .otherwise(F.concat(F.lit("^"), F.substring("title", 1, 5), F.lit("x*"))))
    searches = a.ats_jobs.select(k.alias("search_id"), q.alias("q"))
    texts = a.ats_jobs.select(k.alias("id"), F.concat_ws(" ", "title", "company").alias("text"))
    return se.hits_per_search(searches, texts, se.search_regex)


AS_OF = "2024-03-15 06:00:00"


@register("days_posted", sql=f"""
select job_id, cast(floor((epoch(timestamp '{AS_OF}') - epoch(cast(date_posted as timestamp))) / 86400) as bigint) as days_ago
from ats_jobs""")
def q_days_posted(spark, sf_dir, as_of: str = AS_OF):
    """"Posted N days ago": whole 24-hour periods between posting and ``as_of``."""
    a = Ats(spark, sf_dir)
    secs = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("date_posted").cast("timestamp"))
    return a.ats_jobs.select("job_id", F.floor(secs / 86400).cast("long").alias("days_ago"))


@register("html_escape_br", sql="""
select job_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
       '"', '&#34;'), '''', '&#39;'), chr(10), '<br>') as html from ats_postings""")
def q_html_escape_br(spark, sf_dir):
    """Description rendered for HTML: escape &, <, >, quotes, then newlines to <br>."""
    a = Ats(spark, sf_dir)
    return a.ats_postings.select("job_id", html_escape_br(F.col("text")).alias("html"))


def html_escape_br(c):
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
                     ("\n", "<br>")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# ---------------------------------------------------- skill catalogue upkeep ---

FUZZY_T = 0.7


def fuzzy_user_skills(a: Ats, threshold: float = FUZZY_T):
    """(user_id, skill_id, name): catalogue skills (lower-cased) within Levenshtein ratio
    ``threshold`` of any of the user's résumé skills, for all users at once."""
    cat_ = a.ats_skill_catalog.select("skill_id", "name", F.lower("name").alias("pattern"))
    rs = a.ats_resume_skills.select("user_id", F.col("skill").alias("resume_skill"))
    pairs = fz.fuzzy_value_pairs(rs, cat_, "resume_skill", "pattern", threshold)
    return (rs.join(pairs, "resume_skill").join(cat_, "pattern")
              .select("user_id", "skill_id", "name").distinct())


_SQL_FUZZY = f"""
rs as (select distinct skill from ats_resume_skills where length(skill) > 0),
fm as (select rs.skill, c.skill_id, c.name from rs join ats_skill_catalog c
       on 1.0 - levenshtein(lower(c.name), rs.skill) / greatest(length(lower(c.name)), length(rs.skill)) >= {FUZZY_T}),
fus as (select distinct u.user_id, fm.skill_id, fm.name from ats_resume_skills u join fm on fm.skill = u.skill)"""


@register("fuzzy_skill_match", sql=f"""
with {_SQL_FUZZY}
select user_id, skill_id, name from fus""")
def q_fuzzy_skill_match(spark, sf_dir):
    """Catalogue skills each user has, by fuzzy match of résumé skills (ratio >= 0.7)."""
    return fuzzy_user_skills(Ats(spark, sf_dir))


@register("levenshtein_ratio", sql="""
with v as (select distinct p_name as name,
             case when p_partkey % 3 = 0 then replace(p_name, 'i', '')
                  when p_partkey % 3 = 1 then concat(p_name, 's') else p_name end as spelling from part)
select name, spelling, levenshtein(name, spelling) as distance,
       round(greatest(0.0, 1.0 - levenshtein(name, spelling) / greatest(length(name), length(spelling))), 6) as ratio
from v""")
def q_levenshtein_ratio(spark, sf_dir):
    """Distance and ratio between each catalogue name and the résumé spellings derived from it."""
    a = Ats(spark, sf_dir)
    k = F.col("p_partkey")
    spelling = (F.when(k % 3 == 0, F.replace(F.col("p_name"), F.lit("i"), F.lit("")))
                 .when(k % 3 == 1, F.concat(F.col("p_name"), F.lit("s"))).otherwise(F.col("p_name")))
    v = a.part.select(F.col("p_name").alias("name"), spelling.alias("spelling")).distinct()
    return v.select("name", "spelling", F.levenshtein("name", "spelling").cast("long").alias("distance"),
                    F.round(levenshtein_ratio(F.col("name"), F.col("spelling")), 6).alias("ratio"))


@register("resolve_skill_names", sql="""
select r.user_id, r.skill, c.skill_id from ats_resume_skills r join ats_skill_catalog c on c.name = r.skill""")
def q_resolve_skill_names(spark, sf_dir):
    """Skill names to ids; names missing from the catalogue are dropped."""
    a = Ats(spark, sf_dir)
    return (a.ats_resume_skills.join(a.ats_skill_catalog, F.col("skill") == F.col("name"))
             .select("user_id", "skill", "skill_id"))


@register("user_skill_names", sql="""
select c.skill_id, c.name from ats_skill_catalog c
where c.skill_id in (select c2.skill_id from ats_resume_skills r join ats_skill_catalog c2 on c2.name = r.skill)""")
def q_user_skill_names(spark, sf_dir):
    """Catalogue entries held by at least one user (semi join on resolved ids)."""
    a = Ats(spark, sf_dir)
    held = a.ats_resume_skills.join(a.ats_skill_catalog, F.col("skill") == F.col("name")).select("skill_id")
    return a.ats_skill_catalog.join(held, "skill_id", "left_semi").select("skill_id", "name")


@register("replace_user_skills", sql=f"""
with {_SQL_FUZZY},
refreshed as (select distinct user_id from ats_resume_skills)
select user_id, skill_id, 'kept' as origin from ats_user_skill where user_id not in (select user_id from refreshed)
union all select user_id, skill_id, 'resume' as origin from fus""")
def q_replace_user_skills(spark, sf_dir):
    """Every user with a résumé gets exactly the freshly matched skills, in a table keyed by user; others
    keep theirs, and buckets without a refreshed user are not rewritten."""
    a = Ats(spark, sf_dir)
    path = shared_dir(spark, "user-skills", uuid.uuid4().hex)
    keyed.create(a.ats_user_skill.select("user_id", "skill_id", F.lit("kept").alias("origin")), path, "user_id")
    new = fuzzy_user_skills(a).select("user_id", "skill_id", F.lit("resume").alias("origin"))
    keyed.replace_by_owner(spark, path, a.ats_resume_skills.select("user_id"), new, "user_id")
    return keyed.read(spark, path).select("user_id", "skill_id", "origin")


@register("seed_missing", sql="""
with names as (select distinct lower(skill) as name from ats_resume_skills
               where lower(skill) not in (select lower(name) from ats_skill_catalog)),
mx as (select coalesce(max(skill_id), 0) as m from ats_skill_catalog)
select name, cast(skill_id as bigint) as skill_id, false as seeded from ats_skill_catalog
union all
select n.name, cast(mx.m + row_number() over (order by n.name) as bigint), true from names n, mx""")
def q_seed_missing(spark, sf_dir):
    """Insert résumé skill names missing from the catalogue, with ids after the current maximum."""
    a = Ats(spark, sf_dir)
    catalog = a.ats_skill_catalog.checkpoint(eager=True)
    names = (a.ats_resume_skills.select(F.lower("skill").alias("name")).distinct()
              .join(catalog.select(F.lower("name").alias("name")), "name", "left_anti"))
    start = (catalog.agg(F.max("skill_id")).first()[0] or 0) + 1
    new = with_sequence(names, ["name"], "skill_id", start=start)
    return (catalog.select("name", F.col("skill_id").cast("long").alias("skill_id"), F.lit(False).alias("seeded"))
                   .unionByName(new.select("name", "skill_id", F.lit(True).alias("seeded"))))


@register("skill_intersect", sql="""
select distinct x.applicant_id as user_id, x.job_id, s.skill_id
from ats_applications x join ats_job_skill s on s.job_id = x.job_id
join ats_user_skill u on u.user_id = x.applicant_id and u.skill_id = s.skill_id""")
def q_skill_intersect(spark, sf_dir):
    """Per application, the skills the user and the job share (set intersection, long form)."""
    a = Ats(spark, sf_dir)
    p = a.ats_application_rows.select(F.col("applicant_id").alias("user_id"), "job_id").distinct()
    return (ov.with_shared_skills(p, a.ats_user_skill, a.ats_job_skill)
              .select("user_id", "job_id", F.explode("shared").alias("skill_id")))
