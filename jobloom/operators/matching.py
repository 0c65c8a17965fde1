"""Set-based matching between applicants and jobs.

The reference scores one applicant against every job in a Python loop.  Here distinct skill
strings of both sides are matched once (exact substring join on n-gram keys) and become word
numbers.  Skill lists travel in blocks to the applicants (or applicants to the lists), each block
as posting lists of its words; hits are counted there and only what may still be among the first k is
kept, so no row is formed for an applicant and a list that merely share a skill.  Pairs without any
hit enter a top-k only for groups whose k-th hit score does not beat what such a pair can score,
from rankings that are deepened until enough of them are free.  Entry points:
:func:`top_k_jobs_by_list` (jobs per applicant) and :func:`top_k_applicants_by_list` (applicants
per job).  Applicant and job ids are whole numbers.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import experience_match_pct
from ..session import release
from .folding import BLOCK_SIZE, Postings, fold
from .partitioning import dealt
from .sequence import with_sequence
from .topk import top_k_per

# Longest key used to find substring candidates; a value of length <= GRAM is
# matched by equality on the key alone.
GRAM = 3


def grams(v: Column) -> Column:
    """All substrings of ``v`` of length 1..GRAM as structs (len, gram), plus (0, '')."""
    n = F.length(v)

    def of_len(L: int) -> Column:
        # a one-argument lambda: transform() passes (element, index) to two-argument ones
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (L - 1), F.lit(1))),
                            lambda i: F.struct(F.lit(L).alias("len"), F.substring(v, i, L).alias("gram")))
        return F.when(n >= L, grams).otherwise(F.array().cast("array<struct<len:int,gram:string>>"))

    per_len = [of_len(L) for L in range(1, GRAM + 1)]
    empty = F.array(F.struct(F.lit(0).alias("len"), F.lit("").alias("gram")))
    return F.array_distinct(F.concat(empty, *per_len))


def contained_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer_value, inner_value) for every ``inner`` string contained in an ``outer`` string.

    Exact: ``w`` is a substring of ``v`` iff ``w``'s first GRAM characters occur in ``v`` and the
    full containment check holds, so ``v`` is expanded into its short substrings (3·len rows)
    and ``w`` is keyed by (min(len, GRAM), prefix).  Inputs are single-column frames of values.
    """
    o = outer.toDF("outer_value").distinct()
    i = inner.toDF("inner_value").distinct()
    o_keys = o.select("outer_value", F.explode(grams(F.col("outer_value"))).alias("k")).select(
        "outer_value", F.col("k.len").alias("klen"), F.col("k.gram").alias("kgram"))
    i_keys = i.select("inner_value",
                      F.least(F.length("inner_value"), F.lit(GRAM)).alias("klen"),
                      F.substring("inner_value", 1, GRAM).alias("kgram"))
    return (o_keys.join(i_keys, ["klen", "kgram"])
                  .where(F.contains(F.col("outer_value"), F.col("inner_value")))
                  .select("outer_value", "inner_value")
                  .distinct())


def either_contains_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_value, right_value) where one contains the other."""
    a = contained_pairs(left, right).toDF("left_value", "right_value")
    b = contained_pairs(right, left).select(F.col("inner_value").alias("left_value"),
                                            F.col("outer_value").alias("right_value"))
    return a.unionByName(b).distinct()


def _skills_pct(n_hit: Column, n_job: Column) -> Column:
    return F.when(n_job == 0, F.lit(100.0)).otherwise(
        F.coalesce(n_hit, F.lit(0)).cast("double") / n_job.cast("double") * 100.0)


def _years_key(y: Column) -> Column:
    return F.coalesce(y.cast("string"), F.lit("NA"))


def _score(skills: Column, exp: Column) -> Column:
    return F.round(skills * 0.6 + exp * 0.4, 2)


def _cents(score: np.ndarray) -> np.ndarray:
    """Scores rounded to hundredths, halves up in their shortest decimal form, as ``round`` does in SQL."""
    x = score * 100.0
    out = np.floor(x + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        out[i] = int(Decimal(repr(float(score[i]))).quantize(Decimal("0.01"), ROUND_HALF_UP).scaleb(2))
    return out


def _experience(years, required) -> np.ndarray:
    """``experience_match_pct`` of arrays or numbers; nan stands for null."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(years >= required, 100.0, years / required * 100.0)
    return np.where(np.isnan(years) | np.isnan(required), 50.0, ratio)


def _or_nan(x: float | None) -> float:
    return math.nan if x is None else x


def matched_words(applicant_skills: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applicant_id, words) and (lst, n, words): numbers of the job-skill words that contain, or are contained in,
    a skill of the applicant, and of the words of each list, once for each position, as far as an applicant
    matches them.  Both arrays are bounded by one profile or posting."""
    lists = jobs.groupBy("lst", "n").agg(F.first("skills").alias("skills"))
    lw = lists.select("lst", "n", F.explode("skills").alias("word")).checkpoint(eager=True)
    a = applicant_skills.select("applicant_id", "skill").distinct().checkpoint(eager=True)
    m = either_contains_pairs(lw.select("word"), a.select("skill")).toDF("word", "skill").checkpoint(eager=True)
    number = with_sequence(m.select("word").distinct(), ["word"], "w")
    own = a.join(m, "skill").join(number, "word").groupBy("applicant_id").agg(F.collect_set("w").alias("words"))
    wanted = lw.join(number, "word").groupBy("lst", "n").agg(F.collect_list("w").alias("words"))
    return own.checkpoint(eager=True), wanted.checkpoint(eager=True)


class _Lists:
    """A block of skill lists, with the bounds of their jobs' required years and ids."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy()
        self.key, self.n, self.low, self.any_null = column("_key"), column("n"), column("low"), column("any_null")
        self.first, self.last = column("first"), column("last")
        self.postings = Postings(rows.column("words").combine_chunks())


def promising_lists(applicants: DataFrame, lists: DataFrame, k: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(applicant_id, y, lst, n, h, done): of the lists with h > 0 positions matched, those whose best job may be among the
    applicant's first k, and the jobs of the list that were applied to.  ``applicants``: applicant_id, y, words, applied
    (the list of each job applied to) and, unless none was, applied_jobs (these jobs); ``lists``: _key, n, words, size, low (the least required years), any_null, first
    (the smallest job id) and last (an id that the list's best job does not exceed, whatever the applicant's years).

    The best job of a list that the applicant has not applied to is sure to be reached: once k lists are ahead of
    a list by score, or by id at the same score, none of its jobs matters."""
    def step(block: _Lists, _, years, words, applied, applied_jobs, kept):
        found, h = block.postings.count(np.array(words or [], np.int64))
        y, low = _or_nan(years), block.low[found]
        experience = np.maximum(np.where(np.isnan(low), 0.0, _experience(y, low)), np.where(block.any_null[found], 50.0, 0.0))
        cents = _cents(h / block.n[found] * 100.0 * 0.6 + experience * 0.4)
        sure = ~np.isin(block.key[found], np.array(applied or [], np.int64))
        new = (block.key[found], block.n[found].astype(np.int64), h, cents, block.first[found], block.last[found], sure.astype(np.int64))
        old = np.array([list(x.values()) for x in kept], np.int64).reshape(-1, 7).T
        rows = [np.concatenate(x) for x in zip(old, new)]
        _, _, _, cents, first, last, sure = rows
        ahead = np.flatnonzero(sure)
        if len(ahead) >= k and not y < 0:               # ratios of negative years have no such bound
            kth = ahead[np.lexsort((last[ahead], -cents[ahead]))[k - 1]]
            keep = (cents > cents[kth]) | ((cents == cents[kth]) & (first <= last[kth]))
            rows = [x[keep] for x in rows]
        names = ("lst", "n", "h", "cents", "first", "last", "sure")
        return ([dict(zip(names, row)) for row in zip(*(x.tolist() for x in rows))],)

    one = "struct<lst:bigint,n:bigint,h:bigint,cents:bigint,first:bigint,last:bigint,sure:bigint>"
    none = F.array().cast("array<bigint>")
    jobs = F.coalesce("applied_jobs", none) if "applied_jobs" in applicants.columns else none
    rows = dealt(applicants.select("applicant_id", "y", "words", F.coalesce("applied", none).alias("applied"), jobs.alias("applied_jobs")), "applicant_id")
    out = fold(rows, lists, "size", _Lists, step, {"kept": f"array<{one}>"}, {"kept": []}, block_size)
    out = out.select("applicant_id", "y", F.arrays_zip("applied", "applied_jobs").alias("applied"), F.inline("kept"))
    of_list = F.transform(F.filter("applied", lambda t: t["applied"] == F.col("lst")), lambda t: t["applied_jobs"])
    return out.select("applicant_id", "y", "lst", "n", "h", of_list.alias("done"))


class _People:
    """A block of applicants."""

    def __init__(self, rows: pa.Table):
        self.key, self.years = rows.column("_id").to_numpy(), rows.column("y").to_numpy().astype(np.float64)
        self.postings = Postings(rows.column("words").combine_chunks())


def best_people(lists: DataFrame, applicants: DataFrame, k: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(lst, rkey, applicant_id, h): the first k applicants with h > 0 positions matched, by score and id, for each
    list and required years.  ``lists``: lst, n, words, required (array of rkey and req_years);
    ``applicants``: _key, _id, y, words, size."""
    def step(block: _People, _, n, words, required, top):
        values, times = np.unique(np.array(words, np.int64), return_counts=True)
        found, h = block.postings.count(values, times)
        skills, out = h / n * 100.0 * 0.6, []
        for r in required:
            cents = _cents(skills + _experience(block.years[found], _or_nan(r["req_years"])) * 0.4)
            near = np.arange(len(found))
            if len(found) > k:
                near = np.flatnonzero(cents >= np.partition(cents, -k)[-k])
            near = near[np.lexsort((block.key[found[near]], -cents[near]))[:k]]
            new = [{"rkey": r["rkey"], "applicant_id": i, "h": c, "cents": s} for i, c, s in
                   zip(block.key[found[near]].tolist(), h[near].tolist(), cents[near].tolist())]
            old = [x for x in top if x["rkey"] == r["rkey"]]
            out += sorted(old + new, key=lambda x: (-x["cents"], x["applicant_id"]))[:k]
        return (out,)

    one = "struct<rkey:string,applicant_id:bigint,h:bigint,cents:bigint>"
    rows = dealt(lists.select("lst", "n", "words", "required"), "lst")
    out = fold(rows, applicants, "size", _People, step, {"top": f"array<{one}>"}, {"top": []}, block_size)
    return out.select("lst", F.inline("top")).select("lst", "rkey", "applicant_id", "h")


def _without_hit(pairs: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (applicant_id, lst) whose applicant matches no word of the list."""
    rows = pairs.join(own.select("applicant_id", F.col("words").alias("_own")), "applicant_id", "left").join(
        wanted.select("lst", F.col("words").alias("_wanted")), "lst", "left")
    return rows.where(~F.coalesce(F.arrays_overlap("_own", "_wanted"), F.lit(False))).drop("_own", "_wanted")


def _fill_no_hit(needy: DataFrame, gid: list[str], items: DataFrame, k: int, exp, free) -> DataFrame:
    """The best ``k`` items without a skill hit for each group of ``needy``.

    ``needy``: the id columns ``gid``, gkey / gval (years) and gbase (points it has in any case);
    ``items``: item_id, ikey / ival / ibase.  Items of one (ikey, ibase) tie for every group and go
    by id.  The distinct years values of both sides (two value domains) are scored once; each
    years value gets a ranking of ``depth`` items, ``free`` removes those a group may not take,
    and groups left with fewer than ``k`` go on with a deeper ranking.
    """
    items = items.select("item_id", "ikey", "ival", "ibase")
    classes = items.groupBy("ikey", "ibase").agg(F.first("ival").alias("ival"))
    total = items.count()
    by_id = Window.partitionBy("ikey", "ibase").orderBy("item_id")
    pending, out, depth = needy.checkpoint(eager=True), None, max(64, 4 * k)
    while True:
        members = (items.withColumn("_m", F.row_number().over(by_id)).where(F.col("_m") <= depth)
                        .select("ikey", "ibase", "item_id"))
        scores = (pending.select("gkey", "gval", "gbase").distinct().crossJoin(F.broadcast(classes))
                  .withColumn("experience_match", exp(F.col("gval"), F.col("ival")))
                  .withColumn("skills_match", F.col("gbase") + F.col("ibase"))
                  .withColumn("match_score", _score(F.col("skills_match"), F.col("experience_match"))))
        ranked = top_k_per(scores.join(members, ["ikey", "ibase"]), ["gkey", "gbase"],
                           [F.col("match_score").desc(), F.col("item_id")], depth, "_r")
        cand = pending.join(ranked.select("gkey", "gbase", "item_id", "skills_match", "experience_match", "match_score"),
                            ["gkey", "gbase"])
        found = top_k_per(free(cand), gid, [F.col("match_score").desc(), F.col("item_id")], k).select(
            *gid, "item_id", "skills_match", "experience_match", "match_score").checkpoint(eager=True)
        out = found if out is None else out.unionByName(found)
        if depth >= total:
            return out
        full = found.groupBy(*gid).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(*gid)
        pending = pending.join(full, gid, "left_anti").checkpoint(eager=True)
        if pending.limit(1).count() == 0:
            return out
        out = out.join(pending.select(*gid), gid, "left_anti")      # theirs come again, out of the deeper ranking
        depth *= 8


def top_k_jobs_by_list(applicant_skills: DataFrame, applicants: DataFrame, jobs: DataFrame, k: int,
                       excluded: DataFrame | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Exact top-k jobs per applicant, (group_id=applicant_id, item_id=job_id, skills_match,
    experience_match, match_score, rank), by score descending, then id.

    ``applicant_skills``: (applicant_id, skill) normalised; ``applicants``: (applicant_id,
    years); ``jobs``: (job_id, skills array, req_years); ``excluded``: (applicant_id, job_id).

    The skill part of a score depends only on (applicant, skill list), the experience part only
    on the two years.  For each (applicant years, list, hits) that occurs, the list's jobs are
    ranked once by the *rounded* score and id - unequal experience may round to equal scores -
    and each hit (applicant, list) takes the first k + (applied jobs in the list) of it.
    """
    jb = jobs.select("job_id", F.xxhash64("skills").alias("lst"), "req_years", F.size("skills").alias("n"),
                     _years_key(F.col("req_years")).alias("rkey"), "skills")
    # read many times below: written once
    jb = jb.checkpoint(eager=True)
    own, wanted = matched_words(applicant_skills, jb)
    jb = jb.drop("skills")
    ap = applicants.select("applicant_id", F.col("years").alias("y"), _years_key(F.col("years")).alias("ykey")).checkpoint(eager=True)
    ex = None if excluded is None else excluded.select("applicant_id", "job_id").distinct().checkpoint(eager=True)
    # a list's best job is the first of those with the least years, or of those without any
    least = F.min(F.when(F.col("req_years").isNotNull(), F.struct("req_years", "job_id")))["job_id"]
    bounds = jb.groupBy("lst").agg(F.min("req_years").alias("low"), F.max(F.col("req_years").isNull()).alias("any_null"),
                                   F.min("job_id").cast("long").alias("first"),
                                   F.greatest(least, F.min(F.when(F.col("req_years").isNull(), F.col("job_id")))).cast("long").alias("last"))
    lists = wanted.join(bounds, "lst").withColumn("size", F.size("words").cast("long")).withColumnRenamed("lst", "_key")
    people = ap.select("applicant_id", "y").join(own, "applicant_id", "left")
    if ex is None:
        people = people.withColumn("applied", F.array().cast("array<bigint>"))
    else:
        pair = F.collect_list(F.struct("lst", F.col("job_id").cast("long").alias("job_id")))
        done = ex.join(jb.select("job_id", "lst"), "job_id").groupBy("applicant_id").agg(pair.alias("pairs"))
        people = people.join(done.select("applicant_id", F.col("pairs.lst").alias("applied"), F.col("pairs.job_id").alias("applied_jobs")),
                             "applicant_id", "left")
    hits = promising_lists(people, lists, k, block_size).checkpoint(eager=True)
    release(hits.sparkSession)
    cand = hits.withColumn("ykey", _years_key(F.col("y"))).withColumn("x", F.size("done"))
    depth_l = cand.groupBy("lst").agg(F.max("x").alias("xmax"))

    # jobs of one (list, required years) tie and go by id: only the first k + xmax can be reached
    reach = (jb.join(depth_l, "lst")
               .withColumn("_c", F.row_number().over(Window.partitionBy("lst", "rkey").orderBy("job_id")))
               .where(F.col("_c") <= F.lit(k) + F.col("xmax")).select("lst", "job_id", "req_years", "xmax"))
    met = cand.select("ykey", "y", "lst", "n", "h").distinct().join(reach, "lst")
    met = (met.withColumn("skills_match", _skills_pct(F.col("h"), F.col("n")))
              .withColumn("experience_match", experience_match_pct(F.col("y"), F.col("req_years")))
              .withColumn("match_score", _score(F.col("skills_match"), F.col("experience_match"))))
    w = Window.partitionBy("ykey", "lst", "h").orderBy(F.col("match_score").desc(), "job_id")
    ranked = (met.withColumn("lrank", F.row_number().over(w)).where(F.col("lrank") <= F.lit(k) + F.col("xmax"))
                 .select("ykey", "lst", "h", "lrank", "job_id", "skills_match", "experience_match", "match_score")
                 .checkpoint(eager=True))

    # A list's first job bounds its scores; where the applicant applied to none of the list's jobs
    # that score is reached.  The k-th best reached is a floor: lists bounded below it are left out.
    best = ranked.where("lrank = 1").select("ykey", "lst", "h", F.col("match_score").alias("best"))
    cand = cand.select("applicant_id", "ykey", "lst", "h", "x", "done").join(best, ["ykey", "lst", "h"])
    sure = top_k_per(cand.where("x = 0").select("applicant_id", "lst", "best"), ["applicant_id"], [F.col("best").desc()], k, "_r")
    floor = (sure.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("_n"), F.min("best").alias("_floor"))
                 .where(F.col("_n") >= k).select("applicant_id", "_floor"))
    cand = cand.join(floor, "applicant_id", "left").where("_floor is null or best >= _floor")
    rows = (cand.select("applicant_id", "ykey", "lst", "h", "x", "done").join(ranked, ["ykey", "lst", "h"])
                .where((F.col("lrank") <= F.lit(k) + F.col("x")) & ~F.array_contains("done", F.col("job_id").cast("long"))))
    order = [F.col("match_score").desc(), F.col("item_id")]
    rows = rows.select(F.col("applicant_id").alias("group_id"), F.col("job_id").alias("item_id"),
                       "skills_match", "experience_match", "match_score")
    top = top_k_per(rows, ["group_id"], order, k).drop("rank").checkpoint(eager=True)
    release(top.sparkSession)

    # a bound on what a job without a hit can score for an applicant
    b = jb.agg(F.min("req_years").alias("lo"), F.max(F.col("req_years").isNull()).alias("na"),
               F.max(F.col("n") == 0).alias("empty")).first()
    bound = _score(F.lit(100.0 if b.empty else 0.0), F.greatest(F.lit(50.0 if b.na else 0.0),
                   F.coalesce(experience_match_pct(F.col("y"), F.lit(b.lo).cast("double")), F.lit(100.0))))
    odd = (F.col("y") < 0) | F.lit(b.lo is not None and b.lo < 0)        # ratios of negative years have no such bound
    have = top.groupBy(F.col("group_id").alias("applicant_id")).agg(F.count(F.lit(1)).alias("n_top"), F.min("match_score").alias("kth"))
    needy = (ap.join(have, "applicant_id", "left")
               .where(F.col("n_top").isNull() | (F.col("n_top") < k) | (F.col("kth") <= bound) | F.coalesce(odd, F.lit(False)))
               .select("applicant_id", F.col("ykey").alias("gkey"), F.col("y").alias("gval"), F.lit(0.0).alias("gbase")))
    items = jb.select(F.col("job_id").alias("item_id"), F.col("rkey").alias("ikey"), F.col("req_years").alias("ival"),
                      F.when(F.col("n") == 0, 100.0).otherwise(0.0).alias("ibase"))

    def free(c):
        c = _without_hit(c.join(jb.select(F.col("job_id").alias("item_id"), "lst"), "item_id"), own, wanted)
        return c if ex is None else c.join(ex.withColumnRenamed("job_id", "item_id"), ["applicant_id", "item_id"], "left_anti")

    rest = _fill_no_hit(needy, ["applicant_id"], items, k, experience_match_pct, free)
    return top_k_per(top.unionByName(rest.withColumnRenamed("applicant_id", "group_id")), ["group_id"], order, k)


def top_k_applicants_by_list(applicant_skills: DataFrame, applicants: DataFrame, jobs: DataFrame,
                             k: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Exact top-k applicants per job, (group_id=job_id, item_id=applicant_id, skills_match,
    experience_match, match_score, rank), by score descending, then id.

    Jobs with the same (skill list, required years) share one ranking, joined back to the jobs.
    Applicants with the same hits on a list and the same years tie: of each such class the first
    k by id can matter, and only classes with fewer than k applicants strictly ahead.
    """
    jb = jobs.select("job_id", F.xxhash64("skills").alias("lst"), "req_years", F.size("skills").alias("n"),
                     _years_key(F.col("req_years")).alias("rkey"), "skills")
    jb = jb.checkpoint(eager=True)
    sig = jb.select("lst", "n", "req_years", "rkey").distinct().checkpoint(eager=True)
    ap = applicants.select("applicant_id", F.col("years").alias("y"), _years_key(F.col("years")).alias("ykey")).checkpoint(eager=True)
    own, wanted = matched_words(applicant_skills, jb)
    jb = jb.drop("skills")
    required = sig.groupBy("lst").agg(F.collect_set(F.struct("rkey", "req_years")).alias("required"))
    people = (ap.join(own, "applicant_id").select(F.xxhash64("applicant_id").alias("_key"), F.col("applicant_id").cast("long").alias("_id"),
                                                  F.col("y").cast("double").alias("y"), "words", F.size("words").cast("long").alias("size")))
    found = best_people(wanted.join(required, "lst"), people, k, block_size)
    order = [F.col("match_score").desc(), F.col("applicant_id")]
    cols = ["lst", "rkey", "applicant_id", "skills_match", "experience_match", "match_score"]
    top = (found.join(sig, ["lst", "rkey"]).join(ap, "applicant_id")
           .withColumn("skills_match", _skills_pct(F.col("h"), F.col("n")))
           .withColumn("experience_match", experience_match_pct(F.col("y"), F.col("req_years")))
           .withColumn("match_score", _score(F.col("skills_match"), F.col("experience_match"))).select(*cols).checkpoint(eager=True))

    # a bound on what an applicant without a hit can score for a job
    b = ap.agg(F.max("y").alias("hi"), F.min("y").alias("lo"), F.max(F.col("y").isNull()).alias("na")).first()
    bound = _score(F.when(F.col("n") == 0, 100.0).otherwise(0.0), F.greatest(F.lit(50.0 if b.na else 0.0),
                   F.coalesce(experience_match_pct(F.lit(b.hi).cast("double"), F.col("req_years")), F.lit(100.0))))
    odd = (F.col("req_years") < 0) | F.lit(b.lo is not None and b.lo < 0)
    have = top.groupBy("lst", "rkey").agg(F.count(F.lit(1)).alias("n_top"), F.min("match_score").alias("kth"))
    needy = (sig.join(have, ["lst", "rkey"], "left")
                .where(F.col("n_top").isNull() | (F.col("n_top") < k) | (F.col("kth") <= bound) | F.coalesce(odd, F.lit(False)))
                .select("lst", "rkey", F.col("rkey").alias("gkey"), F.col("req_years").alias("gval"),
                        F.when(F.col("n") == 0, 100.0).otherwise(0.0).alias("gbase")))
    items = ap.select(F.col("applicant_id").alias("item_id"), F.col("ykey").alias("ikey"), F.col("y").alias("ival"),
                      F.lit(0.0).alias("ibase"))
    rest = _fill_no_hit(needy, ["lst", "rkey"], items, k, lambda g, i: experience_match_pct(i, g),
                        lambda c: _without_hit(c.withColumn("applicant_id", F.col("item_id")), own, wanted).drop("applicant_id"))
    per_sig = top_k_per(top.unionByName(rest.withColumnRenamed("item_id", "applicant_id").select(*cols)), ["lst", "rkey"], order, k)
    return jb.join(per_sig, ["lst", "rkey"]).select(
        F.col("job_id").alias("group_id"), F.col("applicant_id").alias("item_id"),
        "skills_match", "experience_match", "match_score", "rank")
