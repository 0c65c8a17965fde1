"""Adapter views that map the driver's TPC-H-style tables onto the talent-matching
data model (jobs, applicants, applications, skill bridges, posting and résumé
text, nested JSON hits, a skill catalogue).

Each adapter exists twice: as a DataFrame builder (what the Spark jobs read)
and as the portable SQL text used as a CTE by the DuckDB oracle.  The Spark
builders avoid the unpartitioned ``row_number() over (order by ...)`` of the
SQL form and number rows with :func:`jobloom.operators.sequence.with_sequence`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partitioning import spread
from ..operators.sequence import with_sequence
from .tables import Tables

NL = "\n"
STATUSES_CSV = "Applied,Screening,Interview,Technical Test,Offer,Hired,Rejected"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _nation(t: Tables) -> DataFrame:
    # nation has 25 rows by the TPC-H definition, independent of scale factor.
    return F.broadcast(t.nation.select("n_nationkey", "n_name"))


def ats_jobs(t: Tables) -> DataFrame:
    p = t.part
    size = F.col("p_size")
    exp = (F.when(size % 5 == 0, F.concat(_s(size % 7), F.lit("-"), _s(size % 7 + 3), F.lit(" years")))
            .when(size % 5 == 1, F.concat(_s(size % 7), F.lit("+ years")))
            .otherwise(F.concat(_s(size % 12), F.lit(" years"))))
    return (p.join(_nation(t), F.col("n_nationkey") == F.col("p_partkey") % 25)
             .select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"),
                     F.col("p_brand").alias("company"), F.col("n_name").alias("location"),
                     F.col("p_type").alias("department"),
                     F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("skills_required"),
                     exp.alias("experience_required"),
                     F.when(size % 4 == 0, "Closed").otherwise("Open").alias("status"),
                     (size % 2 == 0).alias("is_full_time"),
                     F.date_add(F.lit("2024-01-01").cast("date"),
                                (F.col("p_partkey") % 60).cast("int")).alias("date_posted")))


def ats_applicants(t: Tables) -> DataFrame:
    years = F.floor(F.abs("c_acctbal")).cast("long") % 15
    return t.customer.select(F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"),
                             F.concat(_s(years), F.lit(" years")).alias("experience"))


def _applications(t: Tables, with_ids: bool) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cols = [F.col("o_custkey").alias("applicant_id"), F.col("l_partkey").alias("job_id"),
            F.col("o_orderdate").alias("applied_date"),
            F.split_part(F.lit(STATUSES_CSV), F.lit(","), (F.col("l_orderkey") % 7).cast("int") + 1).alias("status")]
    if not with_ids:
        return j.select(*cols)
    j = with_sequence(j.drop("o_orderkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                      "application_id", keep=["l_orderkey", "l_partkey", "o_custkey", "o_orderdate"])
    return j.select("application_id", *cols)


def ats_applications(t: Tables) -> DataFrame:
    return _applications(t, True)


def ats_application_rows(t: Tables) -> DataFrame:
    """``ats_applications`` without the id column: no global numbering is planned."""
    return _applications(t, False)


def ats_job_skill(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("job_id"), F.col("l_suppkey").alias("skill_id"))


def ats_user_skill(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_linenumber") <= 2).select("l_orderkey", "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("skill_id"))
              .distinct())


def _pick(csv: str, idx) -> "F.Column":
    return F.split_part(F.lit(csv), F.lit(","), idx.cast("int") + 1)


def ats_postings(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    tenure = (F.when(size % 3 == 0, F.concat(_s(size % 15), F.lit("+ years of experience")))
               .when(size % 3 == 1, F.concat(F.lit("jan "), _s(2000 + size % 10), F.lit(" - mar "),
                                             _s(2012 + size % 8), F.lit(", feb "), _s(2020 + size % 5),
                                             F.lit(" to present")))
               .otherwise(F.lit("no fixed tenure")))
    text = F.concat(
        F.lit("We need a "), _pick("Senior ,Lead ,Staff ,,,", k % 6),
        _pick("software ,data ,ml ,,cloud ", k % 5), _pick("engineer,developer,Analyst,architect", k % 4),
        F.lit(" with "), tenure, F.lit(" in "),
        _pick("python,SQL,c++11,machine learning,Docker,node.js,pythn,go", size % 8),
        F.lit(" and "), _pick("leadership,teamwork,R,kubernetes,git", k % 5),
        F.lit("." + NL + NL + "Skills" + NL), F.col("p_name"), F.lit(NL), F.col("p_name"),
        F.lit(NL + "Contact hr"), _s(k), F.lit("@example.com or (555) 123-"),
        F.lpad(_s(k % 10000), 4, "0"), F.lit(NL + "https://jobs.example.com/"), _s(k))
    # a part row is short and its text costs much more: dealt out first, or few files would mean few tasks
    rows = spread(t.part.select("p_partkey", "p_size", "p_name"), "p_partkey")
    return rows.select(k.alias("job_id"), text.alias("text"))


def ats_resumes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(
        F.col("c_name"), F.lit(NL + "Work Experience" + NL + "Data Engineer "),
        F.lpad(_s(k % 12 + 1), 2, "0"), F.lit("/"), _s(2010 + k % 8), F.lit(" - "),
        _s((k * 5) % 12 + 1), F.lit("/"), _s(2014 + k % 9), F.lit(NL + "Analyst "),
        _s((k * 7) % 12 + 1), F.lit("/"), _s(2016 + k % 8), F.lit(" to "),
        F.when(k % 3 == 0, F.lit("Present")).otherwise(F.lit("6/2023")),
        F.lit(NL + NL + "Education" + NL + "Bachelor of Science" + NL + "State University" + NL + NL
              + "Master of Arts" + NL + "Skills" + NL),
        F.col("c_mktsegment"), F.lit(" python, sql"))
    return t.customer.select(k.alias("applicant_id"), text.alias("text"))


def ats_hits(t: Tables) -> DataFrame:
    size = F.col("p_size")
    locs = F.when(size % 4 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('[{"country":"'), F.col("n_name"), F.lit('","address":"addr '), _s(size), F.lit('"}]')))
    js = F.concat(F.lit('{"hit":{"locations":'), locs, F.lit(',"title":"'), F.col("p_name"),
                  F.lit('","company":{"name":"'), F.col("p_brand"), F.lit('","short_name":"'),
                  F.lower("p_brand"), F.lit('"},"short_title":"'), F.lower("p_name"),
                  F.lit('","posted_at":"2024-01-'), F.lpad(_s(size % 28 + 1), 2, "0"), F.lit('"}}'))
    return (t.part.join(_nation(t), F.col("n_nationkey") == F.col("p_partkey") % 25)
                  .select(F.col("p_partkey").alias("hit_id"), js.alias("json")))


def ats_skill_catalog(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    return with_sequence(names, ["name"], "skill_id").select("name", "skill_id")


def ats_resume_skills(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_linenumber") == 1).select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    p = t.part.select("p_partkey", "p_name")
    k = F.col("l_partkey")
    skill = (F.when(k % 3 == 0, F.replace(F.col("p_name"), F.lit("i"), F.lit("")))
              .when(k % 3 == 1, F.concat(F.col("p_name"), F.lit("s")))
              .otherwise(F.col("p_name")))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(p, F.col("p_partkey") == F.col("l_partkey"))
              .select(F.col("o_custkey").alias("user_id"), skill.alias("skill"))
              .distinct())


BUILDERS = {
    "ats_jobs": ats_jobs, "ats_applicants": ats_applicants, "ats_applications": ats_applications,
    "ats_application_rows": ats_application_rows,
    "ats_job_skill": ats_job_skill, "ats_user_skill": ats_user_skill, "ats_postings": ats_postings,
    "ats_resumes": ats_resumes, "ats_hits": ats_hits, "ats_skill_catalog": ats_skill_catalog,
    "ats_resume_skills": ats_resume_skills,
}


class Ats(Tables):
    """``Ats(spark, d).ats_jobs`` builds an adapter; base tables as in :class:`Tables`."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in BUILDERS:
            return BUILDERS[name](self)
        return super().__getattr__(name)


# Portable SQL for the same adapters (Spark and DuckDB agree on these), used as
# CTEs by the oracle queries.
FIXTURE_SQL = {
    "ats_jobs": """select p_partkey as job_id, p_name as title, p_brand as company,
 n_name as location, p_type as department,
 concat(p_name, ' ', lower(p_type)) as skills_required,
 case when p_size % 5 = 0 then concat(cast(p_size % 7 as string),'-',cast(p_size % 7 + 3 as string),' years')
      when p_size % 5 = 1 then concat(cast(p_size % 7 as string),'+ years')
      else concat(cast(p_size % 12 as string),' years') end as experience_required,
 case when p_size % 4 = 0 then 'Closed' else 'Open' end as status,
 p_size % 2 = 0 as is_full_time,
 date '2024-01-01' + cast(p_partkey % 60 as int) as date_posted
 from part join nation on n_nationkey = p_partkey % 25""",
    "ats_applicants": """select c_custkey as applicant_id, c_name as name,
 concat(cast(cast(floor(abs(c_acctbal)) as bigint) % 15 as string),' years') as experience from customer""",
    "ats_applications": """select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as application_id,
 o_custkey as applicant_id, l_partkey as job_id, o_orderdate as applied_date,
 split_part('Applied,Screening,Interview,Technical Test,Offer,Hired,Rejected', ',', cast(l_orderkey % 7 as int) + 1) as status
 from orders join lineitem on l_orderkey = o_orderkey""",
    "ats_job_skill": "select l_partkey as job_id, l_suppkey as skill_id from lineitem",
    "ats_user_skill": """select distinct o_custkey as user_id, l_suppkey as skill_id from orders join lineitem on l_orderkey=o_orderkey where l_linenumber <= 2""",
    "ats_postings": """select p_partkey as job_id, concat('We need a ',
 split_part('Senior ,Lead ,Staff ,,,', ',', cast(p_partkey % 6 as int)+1),
 split_part('software ,data ,ml ,,cloud ', ',', cast(p_partkey % 5 as int)+1),
 split_part('engineer,developer,Analyst,architect', ',', cast(p_partkey % 4 as int)+1),
 ' with ', case when p_size % 3 = 0 then concat(cast(p_size % 15 as string), '+ years of experience')
   when p_size % 3 = 1 then concat('jan ', cast(2000 + p_size % 10 as string), ' - mar ', cast(2012 + p_size % 8 as string), ', feb ', cast(2020 + p_size % 5 as string), ' to present')
   else 'no fixed tenure' end,
 ' in ', split_part('python,SQL,c++11,machine learning,Docker,node.js,pythn,go', ',', cast(p_size % 8 as int)+1),
 ' and ', split_part('leadership,teamwork,R,kubernetes,git', ',', cast(p_partkey % 5 as int)+1),
 '.', chr(10), chr(10), 'Skills', chr(10), p_name, chr(10), p_name, chr(10), 'Contact hr', cast(p_partkey as string),
 '@example.com or (555) 123-', lpad(cast(p_partkey % 10000 as string), 4, '0'), chr(10), 'https://jobs.example.com/', cast(p_partkey as string)) as text from part""",
    "ats_resumes": """select c_custkey as applicant_id, concat(c_name, chr(10), 'Work Experience', chr(10),
 'Data Engineer ', lpad(cast(c_custkey % 12 + 1 as string), 2, '0'), '/', cast(2010 + c_custkey % 8 as string), ' - ', cast((c_custkey*5) % 12 + 1 as string), '/', cast(2014 + c_custkey % 9 as string), chr(10),
 'Analyst ', cast((c_custkey*7) % 12 + 1 as string), '/', cast(2016 + c_custkey % 8 as string), ' to ', case when c_custkey % 3 = 0 then 'Present' else '6/2023' end, chr(10), chr(10),
 'Education', chr(10), 'Bachelor of Science', chr(10), 'State University', chr(10), chr(10), 'Master of Arts', chr(10),
 'Skills', chr(10), c_mktsegment, ' python, sql') as text from customer""",
    "ats_hits": """select p_partkey as hit_id, concat('{"hit":{"locations":', case when p_size % 4 = 0 then '[]' else concat('[{"country":"', n_name, '","address":"addr ', cast(p_size as string), '"}]') end,
 ',"title":"', p_name, '","company":{"name":"', p_brand, '","short_name":"', lower(p_brand), '"},"short_title":"', lower(p_name), '","posted_at":"2024-01-', lpad(cast(p_size % 28 + 1 as string),2,'0'), '"}}') as json from part join nation on n_nationkey = p_partkey % 25""",
    "ats_skill_catalog": """select p_name as name, row_number() over (order by p_name) as skill_id
 from (select distinct p_name from part) d""",
    "ats_resume_skills": """select distinct o_custkey as user_id,
 case when l_partkey % 3 = 0 then replace(p_name, 'i', '')
      when l_partkey % 3 = 1 then concat(p_name, 's') else p_name end as skill
 from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
 where l_linenumber = 1""",
}


def with_fixtures(sql: str, names: list[str] | None = None) -> str:
    """Prefix ``sql`` with the adapter CTEs it mentions (adapters do not nest)."""
    if names is None:
        used = set(re.findall(r"\bats_[a-z_]+\b", sql))
        names = [n for n in FIXTURE_SQL if n in used]
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
