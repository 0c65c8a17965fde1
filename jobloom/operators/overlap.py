"""Skill-overlap percentages between users and jobs over the bridge tables.

Jobs with the same set of distinct skills overlap alike with every user, so users meet skill
sets, not jobs.  The sets are dealt by hash into blocks of a bounded number of skills, each set
whole in one block; the blocks are sent one after another to the users, whose rows stay where
they are and carry their results along (their best sets, or counts), so no (user, set) row is
ever shuffled.  Inside a block all users of a batch are counted together: the posting lists of their
skills are laid out as (user, set) numbers and sorted, so the time follows the skills they share
and not the number of users times that of blocks.  Users and jobs that share no skill (0 %) come
from counts and short fillers, not from pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folding import fold
from .partitioning import spread
from .topk import top_k_per

MEDIUM, STRONG = 40, 70          # percent, fixed values of the labels
BLOCK_SKILLS = 16_000_000        # skills of one block: some 100 MB in a task
HITS = 2_000_000                 # common skills of users and sets that a task counts at a time


def _pct(num: Column, den: Column) -> Column:
    # 0 when the job has no skills, like the reference's guard
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")) * 100.0, F.lit(0.0))


def job_sets(job_skill: DataFrame) -> DataFrame:
    """(job_id, sid, set, n_job_skills): each job's sorted distinct skills (bounded by one posting) and
    a 64-bit hash that stands for the set."""
    return (job_skill.groupBy("job_id").agg(F.array_sort(F.collect_set("skill_id")).alias("set"))
                     .select("job_id", F.xxhash64("set").alias("sid"), "set", F.size("set").cast("long").alias("n_job_skills")))


class SkillSets:
    """The sets of one block as posting lists: for each skill the sets that hold it."""

    def __init__(self, rows: pa.Table):
        self.sid, self.n_jobs, self.first_job = (rows.column(c).to_numpy() for c in ("_key", "n_jobs", "first_job"))
        sets = rows.column("set").combine_chunks()
        self.n = np.diff(sets.offsets.to_numpy())
        self.skills, held = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self._sets = owner[np.argsort(held, kind="stable")]
        self._ends = np.cumsum(np.bincount(held, minlength=len(self.skills)))

    def share(self, common: np.ndarray, of: np.ndarray) -> np.ndarray:
        return common / self.n[of] * 100.0

    def meet(self, users: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, set, number of common skills) of all users and sets that share a skill, by row and set, for
        some rows of ``users`` (distinct skills) at a time: the work grows with the skills shared, not with the block."""
        skills = users.flatten().to_numpy(zero_copy_only=False)
        if not len(skills) or not len(self.skills):
            return
        row = np.repeat(np.arange(len(users)), np.diff(users.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(self.skills, skills), len(self.skills) - 1)
        known = self.skills[at] == skills
        row, at = row[known], at[known]
        begin = np.where(at > 0, self._ends[at - 1], 0)
        size = self._ends[at] - begin
        upto = np.cumsum(size)
        i = 0
        while i < len(row):
            j = int(np.searchsorted(upto, upto[i] - size[i] + HITS, "right"))
            if j < len(row):                                # whole rows, one at least
                j = int(np.searchsorted(row, row[j], "left"))
                if j <= i:
                    j = int(np.searchsorted(row, row[i], "right"))
            s, total = size[i:j], int(size[i:j].sum())
            places = np.arange(total) + np.repeat(begin[i:j] - (np.cumsum(s) - s), s)
            own = row[i:j] - row[i]
            kind = np.uint32 if (int(own[-1]) + 1) * len(self.n) < 1 << 32 else np.int64
            key = np.repeat((own * len(self.n)).astype(kind), s) + self._sets[places].astype(kind)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            r, found = np.divmod(key[first].astype(np.int64), len(self.n))
            yield row[i] + r, found, np.diff(np.append(first, total))
            i = j

    def common(self, skills: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(set, number of common skills) of all sets that share a skill and at least ``least`` percent with one user."""
        for _, found, count in self.meet(pa.ListArray.from_arrays(pa.array([0, len(skills)], pa.int32()), pa.array(skills, pa.int64()))):
            keep = self.share(count, found) >= least
            return found[keep], count[keep]
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _starts(row: np.ndarray) -> np.ndarray:
    """The places where a new row begins."""
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)


def user_sets(users: DataFrame, user_skill: DataFrame) -> DataFrame:
    """(user_id, skills) of every user, spread by user; the array is bounded by one profile."""
    skills = spread(user_skill.select("user_id", "skill_id"), "user_id").groupBy("user_id").agg(F.collect_set("skill_id").alias("skills"))
    return (spread(users.select("user_id"), "user_id").distinct().join(skills, "user_id", "left")
            .withColumn("skills", F.coalesce("skills", F.array().cast("array<bigint>"))))


def fold_sets(users: DataFrame, sets: DataFrame, state: dict[str, str], start: dict, step: Callable, block_skills: int) -> DataFrame:
    """(user_id, *state) after ``step(block, batch) -> new state`` over the distinct ``sets`` in blocks."""
    distinct = sets.where("n_job_skills > 0").groupBy(F.col("sid").alias("_key"), "n_job_skills").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.min("job_id").cast("long").alias("first_job"), F.first("set").cast("array<bigint>").alias("set"))
    rows = users.select("user_id", F.col("skills").cast("array<bigint>").alias("skills"))
    return fold(rows, distinct.checkpoint(eager=True), "n_job_skills", SkillSets, step, state, start, block_skills, whole=True).drop("skills")


def top_overlap(users: DataFrame, jobs: DataFrame, user_skill: DataFrame, job_skill: DataFrame, k: int, block_skills: int = BLOCK_SKILLS) -> DataFrame:
    """Top-k jobs of every user by (overlap % desc, job_id): |distinct common skills| / |distinct job
    skills| * 100.  Users with fewer than k overlapping jobs are filled with 0 % jobs by id."""
    sets = job_sets(job_skill).checkpoint(eager=True)

    # k sets ahead of a set hold k jobs ahead of all of its jobs: only the first k sets can matter
    names = ("sid", "n_common", "n_job_skills", "first_job", "overlap_pct")

    def best(block: SkillSets, batch: pa.RecordBatch) -> list[pa.Array]:
        kept = batch.column("best")
        n_kept = np.diff(kept.offsets.to_numpy())
        old = [np.repeat(np.arange(len(kept)), n_kept), *(c.to_numpy(zero_copy_only=False) for c in kept.flatten().flatten())]
        least = np.zeros(len(kept))
        full = np.flatnonzero(n_kept == k)
        least[full] = old[-1][np.cumsum(n_kept)[full] - 1]
        parts = [old]
        for row, found, count in block.meet(batch.column("skills")):
            share = block.share(count, found)
            keep = share >= least[row]
            row, found, count, share = row[keep], found[keep], count[keep], share[keep]
            starts = _starts(row)
            ends = np.append(starts[1:], len(row))
            many = ends - starts > k
            near = np.ones(len(row), bool)
            for a, b in zip(starts[many].tolist(), ends[many].tolist()):
                near[a:b] = share[a:b] >= np.partition(share[a:b], -k)[-k]
            row, found, count, share = row[near], found[near], count[near], share[near]
            parts.append([row, block.sid[found], count, block.n[found], block.first_job[found], share])
        row, *fields = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((fields[3], -fields[4], row))
        row, starts = row[order], _starts(row[order])
        first = np.repeat(starts, np.diff(np.append(starts, len(row)))) if len(row) else starts
        take = np.arange(len(row)) - first < k
        n = np.bincount(row[take], minlength=len(kept))
        of = kept.type.value_type
        structs = pa.StructArray.from_arrays([pa.array(x[order][take], of.field(c).type) for c, x in zip(names, fields)], fields=list(of))
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), structs).cast(kept.type)]

    one = "struct<sid:bigint,n_common:bigint,n_job_skills:bigint,first_job:bigint,overlap_pct:double>"
    kept = fold_sets(user_sets(users, user_skill), sets, {"best": f"array<{one}>"}, {"best": []}, best, block_skills)
    kept = kept.select("user_id", F.inline("best")).drop("first_job")
    first = top_k_per(sets.select("job_id", "sid"), ["sid"], [F.col("job_id")], k, "_m")
    rows = kept.join(first, "sid").select("user_id", "job_id", "n_common", "n_job_skills", "overlap_pct")
    order = [F.col("overlap_pct").desc(), F.col("job_id")]
    top = top_k_per(rows, ["user_id"], order, k).drop("rank").checkpoint(eager=True)
    # a user with fewer than k overlapping jobs has fewer than k to skip among the first 2k jobs by id
    full = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("user_id")
    filler = (jobs.select("job_id").orderBy("job_id").limit(2 * k)
              .join(sets.select("job_id", "n_job_skills"), "job_id", "left"))
    zero = (users.select("user_id").join(full, "user_id", "left_anti").crossJoin(F.broadcast(filler))
            .join(top.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")
            .select("user_id", "job_id", F.lit(0).cast("long").alias("n_common"),
                    F.coalesce("n_job_skills", F.lit(0)).cast("long").alias("n_job_skills"), F.lit(0.0).alias("overlap_pct")))
    return top_k_per(top.unionByName(zero), ["user_id"], order, k)


def bucket_counts(users: DataFrame, jobs: DataFrame, user_skill: DataFrame, job_skill: DataFrame, block_skills: int = BLOCK_SKILLS) -> DataFrame:
    """(user_id, bucket, n_jobs) over all users and all jobs; weak = all jobs - strong - medium."""
    def add(block: SkillSets, batch: pa.RecordBatch) -> list[pa.Array]:
        strong, medium = (batch.column(c).to_numpy().copy() for c in ("strong", "medium"))
        for row, found, count in block.meet(batch.column("skills")):
            share = block.share(count, found)
            for label, of in ((strong, share >= STRONG), (medium, (share >= MEDIUM) & (share < STRONG))):
                np.add.at(label, row[of], block.n_jobs[found[of]])
        return [pa.array(strong), pa.array(medium)]

    n_all = jobs.agg(F.count(F.lit(1)).alias("n_all"))
    rows = fold_sets(user_sets(users, user_skill), job_sets(job_skill), {"strong": "bigint", "medium": "bigint"}, {"strong": 0, "medium": 0}, add, block_skills)
    one = lambda name, n: F.struct(F.lit(name).alias("bucket"), n.alias("n_jobs"))
    return (rows.crossJoin(F.broadcast(n_all))          # one row
            .select("user_id", F.inline(F.array(one("Strong Match", F.col("strong")), one("Medium Match", F.col("medium")),
                                                one("Weak Match", F.col("n_all") - F.col("strong") - F.col("medium")))))
            .where("n_jobs > 0"))


def shared_counts(users: DataFrame, user_skill: DataFrame, job_skill: DataFrame, block_skills: int = BLOCK_SKILLS) -> DataFrame:
    """(user_id, n_jobs_sharing, n_common_total, max_common) of every user, 0 for those without an overlap."""
    def add(block: SkillSets, batch: pa.RecordBatch) -> list[pa.Array]:
        sharing, total, most = (batch.column(c).to_numpy().copy() for c in names)
        for row, found, count in block.meet(batch.column("skills")):
            starts, jobs = _starts(row), block.n_jobs[found]
            own = row[starts]                                # a row is in one part only
            sharing[own] += np.add.reduceat(jobs, starts)
            total[own] += np.add.reduceat(jobs * count, starts)
            most[own] = np.maximum(most[own], np.maximum.reduceat(count, starts))
        return [pa.array(sharing), pa.array(total), pa.array(most)]

    names = ("n_jobs_sharing", "n_common_total", "max_common")
    return fold_sets(user_sets(users, user_skill), job_sets(job_skill), dict.fromkeys(names, "bigint"), dict.fromkeys(names, 0), add, block_skills)


def with_shared_skills(pairs: DataFrame, user_skill: DataFrame, job_skill: DataFrame) -> DataFrame:
    """``pairs`` (user_id, job_id and any other columns, repeats included) with ``shared``, the distinct skills of both;
    n_distinct and n_listed, the job's skills without and with repeats (null: none listed).

    A pair is one row throughout: it takes the user's skills along to the job's, so nothing grows with a job's list."""
    mine = user_skill.groupBy("user_id").agg(F.array_sort(F.collect_set("skill_id")).alias("_mine"))
    wanted = job_skill.groupBy("job_id").agg(F.array_sort(F.collect_set("skill_id")).alias("_wanted"), F.count(F.lit(1)).alias("n_listed"))
    return (pairs.join(mine, "user_id", "left").join(wanted, "job_id", "left")
            .withColumn("shared", F.coalesce(F.array_intersect("_mine", "_wanted"), F.array().cast("array<bigint>")))
            .withColumn("n_distinct", F.when(F.col("_wanted").isNotNull(), F.size("_wanted").cast("long"))).drop("_mine", "_wanted"))


def listed_pct(shared: Column, n_listed: Column) -> Column:
    """Apply-time match %: distinct common skills over the job's raw skill list length (duplicates counted)."""
    return _pct(F.size(shared), n_listed)


def overlap_apply(pairs: DataFrame, user_skill: DataFrame, job_skill: DataFrame) -> DataFrame:
    """Apply-time variant for given (user_id, job_id) pairs: distinct common skills over the
    job's raw skill list length (duplicates counted)."""
    p = with_shared_skills(pairs.select("user_id", "job_id").distinct(), user_skill, job_skill)
    return p.select("user_id", "job_id", listed_pct(F.col("shared"), F.col("n_listed")).alias("overlap_pct"))


def overlap_card(users: DataFrame, shown: DataFrame, user_skill: DataFrame, job_skill: DataFrame) -> DataFrame:
    """Card variant for every user and every shown job (a short list, broadcast): entries of the user's
    skill list found in the job's list, over the raw job list length (duplicates counted)."""
    shown = F.broadcast(shown.select("job_id"))
    js = job_skill.select("job_id", "skill_id").join(shown, "job_id", "left_semi")
    den = js.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_job_skills"))
    hits = (user_skill.select("user_id", "skill_id").join(js.distinct(), "skill_id")
              .groupBy("user_id", "job_id").agg(F.count(F.lit(1)).alias("n_hit")))
    return (users.select("user_id").crossJoin(shown).join(den, "job_id", "left").join(hits, ["user_id", "job_id"], "left")
                .select("user_id", "job_id", _pct(F.coalesce("n_hit", F.lit(0)), F.col("n_job_skills")).alias("overlap_pct")))


def match_bucket(pct: Column) -> Column:
    """Strong / medium / weak label of a match percentage."""
    return F.when(pct >= STRONG, "Strong Match").when(pct >= MEDIUM, "Medium Match").otherwise("Weak Match")
