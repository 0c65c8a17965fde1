"""Ingestion: nested JSON hits, schemaless documents, field alignment, defaults,
insert-if-absent, label write-back/export and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.topk import first_wins, last_wins
from . import keyed

HIT_SCHEMA = ("struct<hit:struct<locations:array<struct<country:string,address:string>>,"
              "title:string,company:struct<name:string,short_name:string>,"
              "short_title:string,posted_at:string>>")

# Sentinel strings for missing scraped fields, in field order.
MISSING_SENTINELS = {
    "Location": "No Location",
    "Company Name": "No Company Info",
    "Post Date": "No Post Date",
    "Overview": "No Overview Found",
    "Payment": "No Payment Info",
    "Contract Type": "No Contract Info",
    "Top Skills": "No Skills Found",
    "Description": "No Description Found",
}

# The loader's field whitelist and its renames.
KEEP_FIELDS = ["Location", "Title", "Overview", "Top Skills", "Description", "Company Name", "Link",
               "Payment", "Contract Type", "Source",
               "posted_at", "location", "title", "name", "short_name", "short_title"]
RENAMES = {"posted_at": "Post Date", "location": "Location", "title": "Title", "name": "Company_Name"}

SEPARATOR_WIDTH = 70


def parse_hits(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse search-API hits (PERMISSIVE: malformed JSON gives a null struct)."""
    return df.withColumn("_h", F.from_json(F.col(json_col), HIT_SCHEMA).getField("hit"))


def path_columns(struct_col: str, spec: str) -> list[Column]:
    """Mini path syntax: ``a@b`` descends into ``a``; ``b$c`` takes siblings ``b`` and ``c``.
    Each selected leaf becomes a column named after the leaf."""
    parts = spec.split("@")
    base = F.col(struct_col)
    for p in parts[:-1]:
        base = base.getField(p)
    return [base.getField(leaf).alias(leaf) for leaf in parts[-1].split("$")]


def hit_location(h: Column) -> Column:
    """'country,address' of the first location, '' without locations."""
    first = F.try_element_at(h.getField("locations"), F.lit(1))
    return F.when(first.isNull(), F.lit("")).otherwise(
        F.concat(first.getField("country"), F.lit(","), first.getField("address")))


def hit_link(base_url: str) -> Column:
    return F.concat(F.lit(base_url + "jobs/"), F.col("short_name"), F.lit("/"), F.col("short_title"))


HIT_FEATURES = ["title", "company@name$short_name", "short_title", "posted_at"]


def project_hits(parsed: DataFrame, base_url: str, id_col: str = "hit_id") -> DataFrame:
    cols = [c for spec in HIT_FEATURES for c in path_columns("_h", spec)]
    return (parsed.select(id_col, hit_location(F.col("_h")).alias("location"), *cols)
                  .withColumn("link", hit_link(base_url)))


def malformed_reason(parsed: DataFrame) -> Column:
    h = F.col("_h")
    return (F.when(h.isNull(), F.lit("malformed"))
             .when(h.getField("company").isNull() | h.getField("company").getField("name").isNull()
                   | h.getField("title").isNull(), F.lit("missing_key"))
             .when(h.getField("company").getField("short_name").isNull()
                   | h.getField("short_title").isNull(), F.lit("missing_link"))
             .otherwise(F.lit("ok")))


def admit_hits(hits: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): hits that parse and have all fields, and the others as they came with a
    status.  A text that is no complete JSON value is malformed, whatever its readable part holds."""
    p = parse_hits(hits, json_col)
    status = F.when(F.get_json_object(json_col, "$").isNull(), F.lit("malformed")).otherwise(malformed_reason(p))
    p = p.withColumn("status", status)
    return p.where("status = 'ok'").drop("status"), p.where("status <> 'ok'").drop("_h")


def page_hits(pages: DataFrame, first_n: int, json_col: str = "json") -> DataFrame:
    """The first ``first_n`` hits of each result page (with their place), without those that lack the
    title or the company; ``pages`` has page_id and a JSON text with a ``hits`` array."""
    parsed = pages.select("page_id", F.from_json(json_col, f"struct<hits:array<{HIT_SCHEMA}>>").getField("hits").alias("hits"))
    h = parsed.select("page_id", F.posexplode(F.slice("hits", 1, first_n)).alias("place", "h")).select(
        "page_id", F.col("place").cast("long").alias("place"), F.col("h.hit").alias("_h"))
    cols = [c for spec in HIT_FEATURES for c in path_columns("_h", spec)]
    return h.select("page_id", "place", *cols).where("title is not null and name is not null")


def admit_in_order(new: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``new`` with ``accepted``: the rows taken one after another by ``order`` (a unique number), each
    refused if one accepted before it shares a value of one of ``keys`` (nulls share nothing).

    Rounds: a row that no earlier undecided row shares a key with is accepted, one that shares a key with an
    accepted row is refused, until none is open.  A round is one minimum and one semi join for each key, so
    there are as many as the longest chain of rows that wait for each other, and a value that most rows
    share is settled by its first row.  The decided rows are written after each round."""
    todo, done = new.select(order, *keys).checkpoint(eager=True), None
    while todo.limit(1).count():
        first = todo
        for k in keys:
            least = todo.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("_least"))
            first = first.join(least, k, "left").where(F.col("_least").isNull() | (F.col("_least") == F.col(order))).drop("_least")
        taken = first.select(order, *keys).checkpoint(eager=True)
        todo = todo.join(taken.select(order), order, "left_anti")
        for k in keys:
            todo = todo.join(taken.select(k), k, "left_anti")
        todo = todo.checkpoint(eager=True)
        done = taken if done is None else done.unionByName(taken)
    flag = F.lit(True).alias("accepted")
    done = todo.select(order, flag) if done is None else done.select(order, flag)
    return new.join(done, order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def registration_reasons(new: DataFrame, existing: DataFrame, skills: DataFrame, order: str) -> DataFrame:
    """``new`` with what each registration is answered, taken one after another by ``order`` (a unique
    number): the user name is taken, the e-mail is taken, the skill name is blank, the skill is in the
    catalogue; else 'ok'.  Taken means on file or accepted earlier in the batch; a skill is in the catalogue
    as soon as an earlier accepted registration has brought it."""
    known = lambda c, flag: existing.select(c).where(F.col(c).isNotNull()).distinct().withColumn(flag, F.lit(True))
    j = new.join(known("username", "_u"), "username", "left").join(known("email", "_e"), "email", "left").checkpoint(eager=True)
    j = admit_in_order(j.where("_u is null and _e is null"), order, ["username", "email"]).unionByName(
        j.where("_u is not null or _e is not null").withColumn("accepted", F.lit(False))).checkpoint(eager=True)
    # the name counts as taken if the accepted row that holds it came before; otherwise it was the e-mail
    holder = j.where("accepted and username is not null").select("username", F.col(order).alias("_holder"))
    j = j.join(holder, "username", "left")
    name_taken = F.coalesce("_u", F.lit(False)) | F.coalesce(F.col("_holder") < F.col(order), F.lit(False))
    catalogue = skills.select(F.lower("skill").alias("_skill")).distinct().withColumn("_s", F.lit(True))
    j = j.withColumn("_skill", F.lower("skill")).join(catalogue, "_skill", "left")
    brings = j.where("accepted and _s is null").where(F.trim("skill") != "").groupBy("_skill").agg(F.min(order).alias("_brought"))
    j = j.join(brings, "_skill", "left")
    reason = (F.when(~F.col("accepted") & name_taken, "Username already exists").when(~F.col("accepted"), "Email already exists")
              .when(F.trim("skill") == "", "Skill name is required").when(F.col("_s") | (F.col("_brought") < F.col(order)), "Skill already exists")
              .otherwise("ok"))
    return j.select(*new.columns, reason.alias("reason"))


def seed_if_empty(target: DataFrame, samples: DataFrame) -> DataFrame:
    """``target``, or ``samples`` if it holds no row (a look at one row decides)."""
    return samples.select(*target.columns) if target.limit(1).count() == 0 else target


def read_record(text: Column) -> Column:
    """Map of a flat record's ``Key: value`` lines (the first ': ' parts them); blank lines and lines
    that begin with '#' are left out, of a repeated key the last counts."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^[^#:\s][^:]*:( |$)"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"),
                                                  F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: F.forall(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] != p["k"]))
    return F.map_from_entries(last)


def join_parts(parts: Column) -> Column:
    """Trimmed parts of a list, comma-joined."""
    return F.array_join(F.transform(parts, lambda x: F.trim(x)), ", ")


def default_if_blank(c: Column, sentinel: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(sentinel))


def doc_key(company: Column, title: Column, lower: bool) -> Column:
    if lower:
        company, title = F.lower(company), F.lower(title)
    return F.concat_ws(",", company, title)


def align_fields(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """Whitelist and rename fields of schemaless JSON documents.  When both spellings of a
    field exist the lower-case one (later in the whitelist) wins; spaces become '_'."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    out: dict[str, Column] = {}
    for f in KEEP_FIELDS:
        name = RENAMES.get(f, f).replace(" ", "_")
        v = m.getItem(f)
        out[name] = v if name not in out else F.coalesce(v, out[name])
    return docs.select("doc_id", *[c.alias(n) for n, c in out.items()])


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order_by: list) -> DataFrame:
    """Rows of ``batch`` to insert: first row per key inside the batch (by ``order_by``),
    and only keys not already present in ``target``."""
    first = first_wins(batch, [key], order_by)
    return first.join(target.select(key).distinct(), key, "left_anti")


def write_back_labels(target: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Partial update by id: ``label`` becomes the new one where an update exists, and stays what it was (null,
    if ``target`` has no labels yet) where none does; ``labels_text`` is the list as stored."""
    old = F.col("label") if "label" in target.columns else F.lit(None).cast("int")
    upd = labels.select(key, F.col("label").alias("_new"))
    return (target.join(upd, key, "left").withColumn("label", F.coalesce("_new", old)).drop("_new")
                  .withColumn("labels_text", F.when(F.col("label").isNull(), F.lit("[]"))
                              .otherwise(F.concat(F.lit("["), F.col("label").cast("string"), F.lit("]")))))


def update_labels(path: str, labels: DataFrame, key: str, buckets: int = keyed.BUCKETS) -> None:
    """Partial update by id of the keyed table at ``path``: its array ``labels`` becomes ``[label]`` where there
    is a label; all other rows keep what they have."""
    new = labels.where(F.col("label").isNotNull()).select(key, F.array("label").alias("labels"))
    keyed.update(labels.sparkSession, path, new, key, buckets)


def export_labels(labels: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """{id: label} export: non-null labels only, last write per id (greatest ``seq``) wins."""
    lab = labels.where(F.col("label").isNotNull())
    if seq is not None:
        lab = last_wins(lab, [key], seq)
    return lab.select(key, "label")


def write_json_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def record_form(fields: list[tuple[str, Column]]) -> Column:
    """Document text of a record: per field ``name:\\nvalue\\n`` then a 70-dash rule and a blank line."""
    rule = "-" * SEPARATOR_WIDTH + "\n\n"
    parts = []
    for name, c in fields:
        parts += [F.lit(f"{name}:\n"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("\n" + rule)]
    return F.concat(*parts)


def drop_last_third(c: Column) -> Column:
    """``s[:-int(len(s)/3)]``: shorter than 3 characters gives ''."""
    n = F.length(c)
    return F.when(n < 3, F.lit("")).otherwise(F.substring(c, F.lit(1), n - F.floor(n / 3).cast("int")))
