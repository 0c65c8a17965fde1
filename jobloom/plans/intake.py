"""Intake of records that can be wrong: result pages with bad hits, registrations, appended
applicants, conditional seeding, flat résumé records, and fusion of given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..sources import ingest as ig
from ..sources.fixtures import Ats
from .registry import register
from .similarity import _SQL_DOT, LINK_BASE, TOP_N, fused_order, similarity_ranking

HITS_PER_PAGE, FIRST_HITS = 20, 12

# Every 17th hit is cut off, the next kinds lack the company, the title or the short name.
_SQL_RAW = """raw as (select hit_id, case hit_id % 17
   when 0 then substr(json, 1, length(json) - 3) when 1 then replace(json, '"company":', '"firm":')
   when 2 then replace(json, '"title":', '"caption":') when 3 then replace(json, '"short_name":', '"short":')
   else json end as json from ats_hits)"""


def raw_hits(a: Ats):
    """Search hits as they arrive: some are cut off or lack a field."""
    json, kind = F.col("json"), F.col("hit_id") % 17
    return a.ats_hits.select("hit_id", F.when(kind == 0, F.substring(json, F.lit(1), F.length(json) - 3))
                             .when(kind == 1, F.replace(json, F.lit('"company":'), F.lit('"firm":')))
                             .when(kind == 2, F.replace(json, F.lit('"title":'), F.lit('"caption":')))
                             .when(kind == 3, F.replace(json, F.lit('"short_name":'), F.lit('"short":')))
                             .otherwise(json).alias("json"))


_SQL_REASON = """case when not json_valid(json) then 'malformed'
   when json_extract_string(json, '$.hit.title') is null or json_extract_string(json, '$.hit.company.name') is null then 'missing_key'
   when json_extract_string(json, '$.hit.company.short_name') is null
     or json_extract_string(json, '$.hit.short_title') is null then 'missing_link' else 'ok' end"""


@register("reject_malformed", sql=f"""
with {_SQL_RAW}
select hit_id, {_SQL_REASON} as status from raw""")
def q_reject_malformed(spark, sf_dir):
    """Every hit with its admission status; rejects keep a reason instead of vanishing."""
    admitted, rejected = ig.admit_hits(raw_hits(Ats(spark, sf_dir)))
    return admitted.select("hit_id", F.lit("ok").alias("status")).unionByName(rejected.select("hit_id", "status"))


@register("source_hit_pages", sql=f"""
with sound as (select hit_id, case when hit_id % 17 = 1 then replace(json, '"company":', '"firm":')
                                   when hit_id % 17 = 2 then replace(json, '"title":', '"caption":') else json end as json from ats_hits),
h as (select hit_id // {HITS_PER_PAGE} as page_id, row_number() over (partition by hit_id // {HITS_PER_PAGE} order by hit_id) - 1 as place, json from sound)
select page_id, place, json_extract_string(json, '$.hit.title') as title, json_extract_string(json, '$.hit.company.name') as name
from h where place < {FIRST_HITS} and json_extract_string(json, '$.hit.title') is not null
  and json_extract_string(json, '$.hit.company.name') is not null""")
def q_source_hit_pages(spark, sf_dir, first_n: int = FIRST_HITS):
    """Result pages with a ``hits`` array: the first n hits of each page, those without the
    required fields skipped one by one."""
    a = Ats(spark, sf_dir)
    json, kind = F.col("json"), F.col("hit_id") % 17
    hits = a.ats_hits.select("hit_id", F.floor(F.col("hit_id") / HITS_PER_PAGE).alias("page_id"),
                             F.when(kind == 1, F.replace(json, F.lit('"company":'), F.lit('"firm":')))
                             .when(kind == 2, F.replace(json, F.lit('"title":'), F.lit('"caption":'))).otherwise(json).alias("json"))
    # a page holds HITS_PER_PAGE hits
    pages = hits.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("hit_id", "json"))).alias("h")).select(
        "page_id", F.concat(F.lit('{"hits":['), F.array_join(F.transform("h", lambda x: x["json"]), ","), F.lit("]}")).alias("json"))
    return ig.page_hits(pages, first_n).select("page_id", "place", "title", "name")


@register("registration_checks", sql="""
with recursive r as (select c_custkey as id, 'user' || cast(c_custkey * 7 % 1100 as varchar) as username,
                  'mail' || cast(c_custkey * 11 % 900 as varchar) || '@example.com' as email,
                  case when c_custkey % 5 = 0 then '' when c_custkey % 5 = 1 then 'python' else 'sql' || cast(c_custkey % 40 as varchar) end as skill from customer),
old as (select * from r where id % 4 = 0), new as (select *, row_number() over (order by id) as i from r where id % 4 <> 0),
walk(i, id, reason, names, mails, skills) as (
    select 0::bigint, null::bigint, '', (select list(username) from old), (select list(email) from old), (select list(distinct skill) from old where skill = 'python')
    union all
    select i, id, reason, case when accepted then list_append(names, username) else names end, case when accepted then list_append(mails, email) else mails end,
        case when reason = 'ok' then list_append(skills, skill) else skills end
    from (select *, reason not in ('Username already exists', 'Email already exists') as accepted
          from (select new.i, new.id, new.username, new.email, new.skill, w.names, w.mails, w.skills,
                       case when list_contains(w.names, new.username) then 'Username already exists' when list_contains(w.mails, new.email) then 'Email already exists'
                            when new.skill = '' then 'Skill name is required' when list_contains(w.skills, new.skill) then 'Skill already exists' else 'ok' end as reason
                from walk w join new on new.i = w.i + 1)))
select id, reason from walk where i > 0""")
def q_registration_checks(spark, sf_dir):
    """New registrations taken one after another: refused if the user name or e-mail is on file or was accepted
    earlier in the batch; then the skill name (given, and not yet in the catalogue)."""
    a = Ats(spark, sf_dir)
    k = F.col("c_custkey")
    r = a.customer.select(k.alias("id"), F.concat(F.lit("user"), (k * 7 % 1100).cast("string")).alias("username"),
                          F.concat(F.lit("mail"), (k * 11 % 900).cast("string"), F.lit("@example.com")).alias("email"),
                          F.when(k % 5 == 0, "").when(k % 5 == 1, "python").otherwise(F.concat(F.lit("sql"), (k % 40).cast("string"))).alias("skill"))
    known = r.where("id % 4 = 0 and skill = 'python'").select("skill").distinct()
    return ig.registration_reasons(r.where("id % 4 <> 0"), r.where("id % 4 = 0"), known, "id").select("id", "reason")


@register("append_applicants", sql="""
select applicant_id, name, experience, null as date_registered from ats_applicants
union all
select c_custkey + 10000000, 'New ' || c_name, '', '2024-03-01' from customer where c_custkey % 10 = 0""")
def q_append_applicants(spark, sf_dir, as_of: str = "2024-03-01"):
    """Append new applicants; they are registered on ``as_of``, columns they lack are blank."""
    a = Ats(spark, sf_dir)
    new = a.customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("applicant_id"),
                                                        F.concat(F.lit("New "), F.col("c_name")).alias("name"))
    old = a.ats_applicants.select("applicant_id", "name", "experience", F.lit(None).cast("string").alias("date_registered"))
    return old.unionByName(new.withColumn("experience", F.lit("")).withColumn("date_registered", F.lit(as_of)))


@register("seed_if_empty", sql="""
select 'filled' as target, count(*) as n from ats_jobs
union all select 'empty', (select count(*) from ats_jobs where job_id <= 5)""")
def q_seed_if_empty(spark, sf_dir):
    """Sample rows go into a table only if it holds none."""
    a = Ats(spark, sf_dir)
    jobs = a.ats_jobs.select("job_id", "title")
    samples = jobs.where("job_id <= 5")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("target"), "n")
    return count(ig.seed_if_empty(jobs, samples), "filled").unionByName(
        count(ig.seed_if_empty(jobs.where("job_id < 0"), samples), "empty"))


RESUME_FIELDS = ["Level", "Skills", "Experience", "Fields", "Task", "Other"]


@register("resume_record_text", sql="""
select applicant_id, concat_ws(chr(10), case when applicant_id % 3 = 0 then 'Senior' else 'Junior' end, 'python, sql: basic',
       experience, 'Field ' || cast(applicant_id % 7 as varchar), 'Build things', '') as text from ats_applicants""")
def q_resume_record_text(spark, sf_dir):
    """Flat ``Key: value`` résumé records read into fields; the six fields joined for encoding
    (a field that the record lacks is blank)."""
    a = Ats(spark, sf_dir)
    k = F.col("applicant_id")
    record = F.concat(F.lit("# profile\nLevel: "), F.when(k % 3 == 0, "Senior").otherwise("Junior"),
                      F.lit("\nSkills: python, sql: basic\nExperience: "), F.col("experience"),
                      F.lit("\n\nTask:   Build things\nFields: Field "), (k % 7).cast("string"))
    fields = ig.read_record(record)
    return a.ats_applicants.select("applicant_id", F.concat_ws("\n", *[
        F.coalesce(fields[f], F.lit("")) for f in RESUME_FIELDS]).alias("text"))


@register("recommend_fused_scores", sql=f"""
with {_SQL_DOT},
given as (select doc_id, cast((doc_id * 37) % 101 as double) / 101.0 as p_yes from documents),
r1 as (select vec_id as job_id, row_number() over (order by score, vec_id) - 1 as rank,
              '{LINK_BASE}' || cast(vec_id as varchar) as link, 0 as src from ds),
r2 as (select doc_id as job_id, row_number() over (order by p_yes, doc_id) - 1 as rank,
              '{LINK_BASE}' || cast(doc_id as varchar) as link, 1 as src from given),
u as (select * from r1 union all select * from r2),
fused as (select job_id, sum(rank / 2.0) as fused_rank, arg_max(link, src) as link from u group by job_id)
select job_id, fused_rank, link from fused order by fused_rank desc, job_id limit {TOP_N}""")
def q_recommend_fused_scores(spark, sf_dir, n: int = TOP_N):
    """The fused recommendation on given model scores: both rankings as in ``recommend_fused``."""
    a = Ats(spark, sf_dir)
    given = a.documents.select("doc_id", (((F.col("doc_id") * 37) % 101).cast("double") / 101.0).alias("score"))
    m = rk.rank_by_score(given, "doc_id").select(F.col("doc_id").alias("job_id"), "rank",
                                                 F.concat(F.lit(LINK_BASE), F.col("doc_id").cast("string")).alias("link"))
    fused = rk.fuse_ranks([similarity_ranking(a), m], "job_id")
    return fused.orderBy(*fused_order("best")).limit(n).select("job_id", "fused_rank", "link")
