"""Queries over sources and sinks: time-range scans, lookups, nested JSON hits,
schemaless documents, insert-if-absent, defaults, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import days as by_day
from ..sources import ingest as ig
from ..sources import keyed
from ..sources.fixtures import Ats
from .registry import register

AS_OF = "2024-01-31 00:00:00"
BASE_URL = "https://jobs.example.com/"
QSIZE = 50


def _ntz(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


@register("scan_time_range", sql=f"""
select event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
from events where ts between timestamp '{AS_OF}' - interval 7 day and timestamp '{AS_OF}' + interval 1 day
order by events.ts, event_id limit {QSIZE}""")
def q_scan_time_range(spark, sf_dir, days: int = 7, as_of: str = AS_OF, size: int = QSIZE):
    """Rows whose timestamp lies in [as_of - days, as_of + 1 day] (both inclusive), at most
    ``size``; the range is pushed to the parquet scan, the cut is a top-n by (ts, id)."""
    a = Ats(spark, sf_dir)
    lo = _ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    hi = _ntz(as_of) + F.expr("INTERVAL 1 DAYS")
    ev = a.events.where(F.col("ts").between(lo, hi))
    return (ev.orderBy("ts", "event_id").limit(size)
              .select("event_id", "user_id", "event_type",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")))


@register("scan_day_partitions", sql=f"""
select event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
from events where ts between timestamp '{AS_OF}' - interval 7 day and timestamp '{AS_OF}' + interval 1 day""")
def q_scan_day_partitions(spark, sf_dir, days: int = 7, as_of: str = AS_OF):
    """All rows of [as_of - days, as_of + 1 day] out of a table kept by day: other days are pruned unread."""
    path = shared_dir(spark, "events-by-day", uuid.uuid4().hex)
    by_day.create(Ats(spark, sf_dir).events, path, "ts")
    lo, hi = _ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"), _ntz(as_of) + F.expr("INTERVAL 1 DAYS")
    return by_day.time_range(spark, path, "ts", lo, hi).select(
        "event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


LOOKUP_ID = 42


@register("point_lookup", sql=f"""
select job_id, title, company, location, department, experience_required, status,
       cast(date_posted as varchar) as date_posted from ats_jobs where job_id = {LOOKUP_ID}""")
def q_point_lookup(spark, sf_dir, job_id: int = LOOKUP_ID):
    """One record by key (the filter reaches the parquet scan of ``part``)."""
    a = Ats(spark, sf_dir)
    return (a.ats_jobs.where(F.col("job_id") == job_id)
             .select("job_id", "title", "company", "location", "department", "experience_required",
                     "status", F.col("date_posted").cast("string").alias("date_posted")))


@register("lookup_batch", sql="""
select k.job_id, j.job_id is not null as is_found, j.title, j.company, j.status
from (select distinct event_id as job_id from events) k left join ats_jobs j on j.job_id = k.job_id""")
def q_lookup_batch(spark, sf_dir):
    """Records of a batch of keys (the jobs that apply clicks name), missing keys reported; keys and records are
    bucketed alike, so the lookup itself moves no rows."""
    a = Ats(spark, sf_dir)
    run = uuid.uuid4().hex
    tables = {"lookup_jobs": a.ats_jobs.select("job_id", "title", "company", "status"),
              "lookup_keys": a.events.select(F.col("event_id").alias("job_id")).distinct()}
    jobs, keys = (keyed.create_bucketed(df, shared_dir(spark, name, run), f"{name}_{run}", "job_id") for name, df in tables.items())
    return keyed.lookup(jobs, keys, "job_id").select("job_id", "is_found", "title", "company", "status")


_SQL_HITS = """
hp as (select hit_id,
   case when coalesce(json_array_length(json, '$.hit.locations'), 0) = 0 then ''
        else json_extract_string(json, '$.hit.locations[0].country') || ',' || json_extract_string(json, '$.hit.locations[0].address') end as location,
   json_extract_string(json, '$.hit.title') as title,
   json_extract_string(json, '$.hit.company.name') as name,
   json_extract_string(json, '$.hit.company.short_name') as short_name,
   json_extract_string(json, '$.hit.short_title') as short_title,
   json_extract_string(json, '$.hit.posted_at') as posted_at
 from ats_hits)"""


def hits_projected(a: Ats, base_url: str = BASE_URL):
    return ig.project_hits(ig.parse_hits(a.ats_hits), base_url)


@register("source_json_hits", sql=f"""
with {_SQL_HITS}
select hit_id, title, name, short_name, short_title, posted_at,
       cast(coalesce(json_array_length(json, '$.hit.locations'), 0) as bigint) as n_locations
from hp join ats_hits using (hit_id) where title is not null and name is not null""")
def q_source_json_hits(spark, sf_dir):
    """Parse nested search hits; hits missing required fields are skipped."""
    a = Ats(spark, sf_dir)
    p = ig.parse_hits(a.ats_hits)
    ok = p.where(ig.malformed_reason(p).isin("ok", "missing_link"))
    return ok.select("hit_id", *[c for spec in ig.HIT_FEATURES for c in ig.path_columns("_h", spec)],
                     F.coalesce(F.size(F.col("_h.locations")), F.lit(0)).cast("long").alias("n_locations"))


@register("nested_project", sql=f"""
with {_SQL_HITS}
select hit_id, location, title, name, short_name, short_title, posted_at,
       '{BASE_URL}jobs/' || short_name || '/' || short_title as link from hp""")
def q_nested_project(spark, sf_dir, base_url: str = BASE_URL):
    """Path projection ``company@name$short_name`` etc., first-location text and link."""
    a = Ats(spark, sf_dir)
    return hits_projected(a, base_url)


_SQL_LISTING = """
ls as (select job_id, case when job_id % 7 = 0 then null else location end as location,
   case when job_id % 11 = 0 then '  ' else company end as company, case when job_id % 5 = 0 then null else cast(date_posted as varchar) end as posted,
   case when job_id % 3 = 0 then null else department end as overview, case when job_id % 4 = 0 then null else '$' || cast(job_id as varchar) end as payment,
   case when job_id % 6 = 0 then '' when job_id % 6 = 1 then 'Full Time' else 'Contract, Remote' end as contract,
   case when job_id % 9 = 0 then null else skills_required end as skills, case when job_id % 8 = 0 then null else title end as description from ats_jobs)"""


@register("default_fields", sql=f"""
with {_SQL_LISTING}
select job_id, coalesce(nullif(trim(location), ''), 'No Location') as location, coalesce(nullif(trim(company), ''), 'No Company Info') as company_name,
       coalesce(nullif(trim(posted), ''), 'No Post Date') as post_date, coalesce(nullif(trim(overview), ''), 'No Overview Found') as overview,
       coalesce(nullif(trim(payment), ''), 'No Payment Info') as payment, coalesce(nullif(contract, ''), 'No Contract Info') as contract_type,
       coalesce(nullif(trim(skills), ''), 'No Skills Found') as top_skills, coalesce(nullif(trim(description), ''), 'No Description Found') as description
from ls""")
def q_default_fields(spark, sf_dir):
    """Sentinel strings for all scraped fields that are absent or blank; the contract type is the
    trimmed parts of a list, comma-joined."""
    a = Ats(spark, sf_dir)
    j, k = a.ats_jobs, F.col("job_id")
    parts = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(F.lit(" Full Time "))).otherwise(
        F.array(F.lit("Contract "), F.lit(" Remote")))
    raw = {"Location": F.when(k % 7 != 0, j.location), "Company Name": F.when(k % 11 == 0, "  ").otherwise(j.company),
           "Post Date": F.when(k % 5 != 0, j.date_posted.cast("string")), "Overview": F.when(k % 3 != 0, j.department),
           "Payment": F.when(k % 4 != 0, F.concat(F.lit("$"), k.cast("string"))), "Contract Type": ig.join_parts(parts),
           "Top Skills": F.when(k % 9 != 0, j.skills_required), "Description": F.when(k % 8 != 0, j.title)}
    return j.select("job_id", *[ig.default_if_blank(c, ig.MISSING_SENTINELS[f]).alias(f.lower().replace(" ", "_")) for f, c in raw.items()])


@register("doc_key", sql="""
select job_id, lower(company) || ',' || lower(title) as key_lower, company || ',' || title as key_raw from ats_jobs""")
def q_doc_key(spark, sf_dir):
    """Document id ``company,title``: lower-cased (listing crawler) and as-is (search API)."""
    a = Ats(spark, sf_dir)
    j = a.ats_jobs
    return j.select("job_id", ig.doc_key(F.col("company"), F.col("title"), True).alias("key_lower"),
                    ig.doc_key(F.col("company"), F.col("title"), False).alias("key_raw"))


def raw_documents(a: Ats, base_url: str = BASE_URL):
    """The schemaless index: listing documents (capitalised field names, lower-cased title and
    company) and search-API documents (lower-case names), one JSON string per document."""
    j = a.ats_jobs
    listing = j.select(
        F.concat(F.lit("L"), F.col("job_id").cast("string")).alias("doc_id"),
        F.to_json(F.struct(F.lower("title").alias("Title"), F.col("location").alias("Location"),
                           F.col("date_posted").cast("string").alias("Post Date"),
                           F.lower("company").alias("Company Name"),
                           F.concat(F.lit(base_url + "job-detail/"), F.col("job_id").cast("string")).alias("Link"),
                           F.col("skills_required").alias("Top Skills"),
                           F.lit("listing").alias("Source"))).alias("doc"))
    h = hits_projected(a, base_url)
    api = h.select(
        F.concat(F.lit("H"), F.col("hit_id").cast("string")).alias("doc_id"),
        F.to_json(F.struct("location", "title", "name", "short_name", "short_title", "posted_at",
                           F.col("link").alias("Link"), F.lit("search_api").alias("Source"))).alias("doc"))
    return listing.unionByName(api)


@register("union_sources", sql=f"""
with {_SQL_HITS}
select 'L' || cast(job_id as varchar) as doc_id, 'listing' as source from ats_jobs
union all select 'H' || cast(hit_id as varchar), 'search_api' from hp""")
def q_union_sources(spark, sf_dir):
    """Two sources with different field sets in one document table."""
    a = Ats(spark, sf_dir)
    d = raw_documents(a)
    return d.select("doc_id", F.get_json_object("doc", "$.Source").alias("source"))


@register("align_fields", sql=f"""
with {_SQL_HITS}
select 'L' || cast(job_id as varchar) as doc_id, location as "Location", lower(title) as "Title",
       cast(null as varchar) as "Overview", skills_required as "Top_Skills", cast(null as varchar) as "Description",
       lower(company) as "Company_Name", '{BASE_URL}job-detail/' || cast(job_id as varchar) as "Link",
       cast(null as varchar) as "Payment", cast(null as varchar) as "Contract_Type", 'listing' as "Source",
       cast(null as varchar) as "Post_Date", cast(null as varchar) as short_name, cast(null as varchar) as short_title
from ats_jobs
union all
select 'H' || cast(hit_id as varchar), location, title, null, null, null, name,
       '{BASE_URL}jobs/' || short_name || '/' || short_title, null, null, 'search_api', posted_at, short_name, short_title
from hp""")
def q_align_fields(spark, sf_dir):
    """Field whitelist + renames over the mixed-schema document table."""
    a = Ats(spark, sf_dir)
    return ig.align_fields(raw_documents(a))


SPLIT_DATE = "2024-01-15"


@register("ingest_insert_if_absent", sql=f"""
with {_SQL_HITS},
k as (select hit_id, name || ',' || title as doc_key, posted_at from hp),
existing as (select distinct doc_key from k where posted_at < '{SPLIT_DATE}'),
batch as (select *, row_number() over (partition by doc_key order by hit_id) as r from k where posted_at >= '{SPLIT_DATE}')
select doc_key, hit_id from batch where r = 1 and doc_key not in (select doc_key from existing)""")
def q_ingest_insert_if_absent(spark, sf_dir, split_date: str = SPLIT_DATE):
    """Insert-if-absent by ``name,title``: hits posted before ``split_date`` are already
    indexed; later ones form the incoming batch (first per key wins)."""
    a = Ats(spark, sf_dir)
    k = hits_projected(a).select("hit_id", "posted_at",
                                 ig.doc_key(F.col("name"), F.col("title"), False).alias("doc_key"))
    existing = k.where(F.col("posted_at") < split_date)
    batch = k.where(F.col("posted_at") >= split_date)
    return ig.insert_if_absent(existing, batch, "doc_key", [F.col("hit_id")]).select("doc_key", "hit_id")


@register("label_writeback", sql="""
select d.doc_id, d.source, l.quality is not null as is_labelled,
       case when l.quality is not null then '[' || cast(l.quality as varchar) || ']' when d.doc_id % 4 = 0 then '[' || cast(d.doc_id % 3 as varchar) || ']'
            else '[]' end as labels_text
from documents d left join labels l on l.doc_id = d.doc_id""")
def q_label_writeback(spark, sf_dir):
    """Set ``Labels = [label]`` on labelled documents of a keyed table; the others, some of them labelled
    before, keep their list."""
    a = Ats(spark, sf_dir)
    k = F.col("doc_id")
    before = F.when(k % 4 == 0, F.array((k % 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    path = shared_dir(spark, "labelled", uuid.uuid4().hex)
    keyed.create(a.documents.select("doc_id", "source", before.alias("labels")), path, "doc_id")
    lab = a.labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    ig.update_labels(path, lab, "doc_id")
    out = keyed.read(spark, path).join(lab, "doc_id", "left")
    text = F.concat(F.lit("["), F.array_join(F.transform("labels", lambda x: x.cast("string")), ","), F.lit("]"))
    return out.select("doc_id", "source", F.col("label").isNotNull().alias("is_labelled"), text.alias("labels_text"))


@register("label_export", sql="""
select doc_id, case when doc_id % 3 = 0 then 1 - quality else quality end as label from labels where quality is not null""")
def q_label_export(spark, sf_dir):
    """{doc_id: label} of labelled documents written as JSON and read back; every third document is
    labelled twice, and the last write per id wins."""
    a = Ats(spark, sf_dir)
    first = a.labels.select("doc_id", F.col("quality").alias("label"), F.lit(0).alias("seq"))
    again = a.labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("label"), F.lit(1).alias("seq"))
    path = shared_dir(spark, "labels", uuid.uuid4().hex)
    ig.write_json_labels(ig.export_labels(first.unionByName(again), "doc_id", "seq"), path)
    return spark.read.schema("doc_id bigint, label int").json(path)


QUEUE_AS_OF, QUEUE_DAYS, QUEUE_SIZE = "2024-03-01", 60, 400


def _form_fields(j):
    return [("Title", j.title), ("Company", j.company), ("Location", j.location),
            ("Department", j.department), ("Experience", j.experience_required)]


_SQL_FORM = """'Title:' || chr(10) || title || chr(10) || repeat('-', 70) || chr(10) || chr(10)
 || 'Company:' || chr(10) || company || chr(10) || repeat('-', 70) || chr(10) || chr(10)
 || 'Location:' || chr(10) || location || chr(10) || repeat('-', 70) || chr(10) || chr(10)
 || 'Department:' || chr(10) || department || chr(10) || repeat('-', 70) || chr(10) || chr(10)
 || 'Experience:' || chr(10) || experience_required || chr(10) || repeat('-', 70) || chr(10) || chr(10)"""


@register("record_form", sql=f"select job_id, {_SQL_FORM} as form from ats_jobs")
def q_record_form(spark, sf_dir):
    """Record -> document text (``name:\\nvalue\\n`` + 70-dash rule per field)."""
    a = Ats(spark, sf_dir)
    j = a.ats_jobs
    return j.select("job_id", ig.record_form(_form_fields(j)).alias("form"))


@register("label_queue", sql=f"""
select job_id, {_SQL_FORM} as form from ats_jobs
where date_posted between date '{QUEUE_AS_OF}' - interval {QUEUE_DAYS} day and date '{QUEUE_AS_OF}'
  and job_id not in (select doc_id from labels)
order by date_posted desc, job_id limit {QUEUE_SIZE}""")
def q_label_queue(spark, sf_dir, as_of: str = QUEUE_AS_OF, days: int = QUEUE_DAYS, size: int = QUEUE_SIZE):
    """Postings of the last ``days`` not yet labelled, newest first, at most ``size``, each with its whole form."""
    a = Ats(spark, sf_dir)
    j = a.ats_jobs
    hi = F.lit(as_of).cast("date")
    recent = j.where(F.col("date_posted").between(F.date_sub(hi, days), hi))
    todo = recent.join(a.labels.select(F.col("doc_id").alias("job_id")), "job_id", "left_anti")
    return (todo.orderBy(F.col("date_posted").desc(), F.col("job_id")).limit(size)
                .select("job_id", ig.record_form(_form_fields(j)).alias("form")))


TRAIN_N = 30


@register("train_holdout_split", sql=f"""
with tr as (select doc_id from labels order by doc_id limit {TRAIN_N})
select l.doc_id, l.quality as label, case when tr.doc_id is null then 'holdout' else 'train' end as split
from labels l left join tr on tr.doc_id = l.doc_id""")
def q_train_holdout_split(spark, sf_dir, n: int = TRAIN_N):
    """First ``n`` labelled ids train, the rest are held out.  The train id set is a top-n
    (size n by construction) and is broadcast."""
    a = Ats(spark, sf_dir)
    lab = a.labels.select("doc_id", F.col("quality").alias("label"))
    train = lab.orderBy("doc_id").limit(n).select("doc_id", F.lit("train").alias("split"))
    return (lab.join(F.broadcast(train), "doc_id", "left")
               .select("doc_id", "label", F.coalesce("split", F.lit("holdout")).alias("split")))


@register("truncate_text", sql="""
select job_id, substr(text, 1, 250) as head_250,
       case when length(text) < 3 then '' else substr(text, 1, length(text) - cast(floor(length(text) / 3) as int)) end as two_thirds
from ats_postings""")
def q_truncate_text(spark, sf_dir):
    """Prefix of 250 characters; text without its last third."""
    a = Ats(spark, sf_dir)
    t = F.col("text")
    return a.ats_postings.select("job_id", F.substring(t, 1, 250).alias("head_250"),
                                 ig.drop_last_third(t).alias("two_thirds"))


@register("embed_text", sql="""
select job_id, concat_ws(chr(10), title, skills_required) as text from ats_jobs""")
def q_embed_text(spark, sf_dir):
    """Text a job is embedded from: title and top skills joined by newline."""
    a = Ats(spark, sf_dir)
    return a.ats_jobs.select("job_id", F.concat_ws("\n", "title", "skills_required").alias("text"))
