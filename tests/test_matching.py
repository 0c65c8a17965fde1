"""Set-based matching against brute force on random small inputs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import scoring as sc
from jobloom.operators import fuzzy as fz
from jobloom.operators import matching as mt
from tests.test_scoring import expected_experience, expected_skills

alphabet = st.text(alphabet="abc ", max_size=6)


@settings(max_examples=15, deadline=None)
@given(outer=st.lists(alphabet, min_size=1, max_size=6), inner=st.lists(alphabet, min_size=1, max_size=6))
def test_contained_pairs_exact(spark, outer, inner):
    o = spark.createDataFrame([(x,) for x in outer], "v string")
    i = spark.createDataFrame([(x,) for x in inner], "w string")
    got = {(r.outer_value, r.inner_value) for r in mt.contained_pairs(o, i).collect()}
    assert got == {(v, w) for v in set(outer) for w in set(inner) if w in v}


def _all_scores(apps, jobs, app_years):
    """(applicant, job) -> rounded score, by the rules of tests/test_scoring.py."""
    return {(a, j): round(expected_skills(mine, asked) * 0.6 + expected_experience(app_years[a], need) * 0.4, 2)
            for a, mine in apps.items() for j, (asked, need) in jobs.items()}


def _best(scores, k, group, item, skip=()):
    out = {}
    for pair, s in scores.items():
        if pair not in skip:
            out.setdefault(pair[group], []).append((-s, pair[item]))
    return {g: [i for _, i in sorted(v)[:k]] for g, v in out.items()}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 9)))
    left, right = {word() for _ in range(90)} | {"blue anvl"}, {word() for _ in range(60)} | {"blue anvil"}
    ldf, rdf = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    for t, strict in ((0.7, False), (0.8, True), (0.34, False), (1.0, False)):
        got = {tuple(r) for r in fz.fuzzy_value_pairs(ldf, rdf, "l", "r", t, strict).collect()}
        close = lambda a, b: 1 - _distance(a, b) / max(len(a), len(b))
        assert got == {(a, b) for a in left for b in right if a and b and (close(a, b) > t if strict else close(a, b) >= t)}


def test_ratio_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("abcdefghij", "abcdefgxyz")], "a string, b string")
    assert df.select(sc.levenshtein_ratio("a", "b") >= 0.7).first()[0]


def _random_case(seed):
    rnd = random.Random(seed)
    vocab = ["ab", "abc", "b", "cab", "bca", "ca", "a"]
    lists = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 3))] for _ in range(6)]
    jobs = {j: (rnd.choice(lists), rnd.choice([None, 0.0, 1.0, 2.0, 3.0])) for j in range(40)}
    apps = {a: sorted({rnd.choice(vocab) for _ in range(rnd.randint(0, 2))}) for a in range(14)}
    years = {a: rnd.choice([None, 0.0, 1.0, 2.5]) for a in apps}
    excluded = {(a, j) for a in apps for j in jobs if rnd.random() < 0.2}
    return jobs, apps, years, excluded


def _frames(spark, jobs, apps, years):
    jdf = spark.createDataFrame([(j, s, r) for j, (s, r) in jobs.items()], "job_id long, skills array<string>, req_years double")
    adf = spark.createDataFrame([(a, s) for a, ss in apps.items() for s in ss] or [(0, "zz")], "applicant_id long, skill string")
    ydf = spark.createDataFrame(list(years.items()), "applicant_id long, years double")
    return jdf, adf, ydf


def _per_group(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.group_id, r.rank)):
        got.setdefault(r.group_id, []).append(r.item_id)
    return got


def test_top_k_jobs_by_list_vs_brute_force(spark):
    for seed in (3, 11):
        jobs, apps, years, excluded = _random_case(seed)
        jdf, adf, ydf = _frames(spark, jobs, apps, years)
        ex = spark.createDataFrame(sorted(excluded), "applicant_id long, job_id long")
        got = _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, 4, ex).collect())
        assert got == _best(_all_scores(apps, jobs, years), 4, 0, 1, excluded)


def test_top_k_applicants_by_list_vs_brute_force(spark):
    jobs, apps, years, _ = _random_case(5)
    jdf, adf, ydf = _frames(spark, jobs, apps, years)
    got = _per_group(mt.top_k_applicants_by_list(adf, ydf, jdf, 3).collect())
    assert got == _best(_all_scores(apps, jobs, years), 3, 1, 0)


def test_rounded_ties_go_by_id(spark):
    """121 and 120 required years round to one score: the smaller id is the top one, for every k."""
    jobs = {1: (["sql"], 121.0), 2: (["sql"], 120.0), 3: (["sql"], 1.0), 4: (["java"], 122.0)}
    jdf, adf, ydf = _frames(spark, jobs, {7: ["sql"]}, {7: 1.0})
    for k in range(1, 5):
        assert _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, k).collect()) == {7: [3, 1, 2, 4][:k]}


def test_real_valued_years_empty_lists_and_distinct_lists(spark):
    rnd = random.Random(21)
    words = [f"s{i}" for i in range(30)]
    for every_list_distinct in (False, True):
        jobs = {j: ([f"only{j}", "common"] if every_list_distinct else rnd.sample(words, rnd.randint(0, 3)),
                    rnd.choice([None, round(rnd.uniform(100, 130), 1)])) for j in range(50)}
        apps = {a: ["common"] if every_list_distinct else rnd.sample(words, rnd.randint(0, 3)) + rnd.choice([[], [""]]) for a in range(9)}
        apps[8] = []
        years = {a: rnd.choice([None, round(rnd.uniform(1, 140), 1)]) for a in apps}
        jdf, adf, ydf = _frames(spark, jobs, apps, years)
        scores = _all_scores(apps, jobs, years)
        for k in (1, 3, 60):
            assert _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, k).collect()) == _best(scores, k, 0, 1)
            assert _per_group(mt.top_k_applicants_by_list(adf, ydf, jdf, k).collect()) == _best(scores, k, 1, 0)


def test_blocks_of_any_size_give_one_ranking(spark):
    jobs, apps, years, excluded = _random_case(17)
    jdf, adf, ydf = _frames(spark, jobs, apps, years)
    ex = spark.createDataFrame(sorted(excluded), "applicant_id long, job_id long")
    scores = _all_scores(apps, jobs, years)
    assert _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, 3, ex, 4).collect()) == _best(scores, 3, 0, 1, excluded)
    assert _per_group(mt.top_k_applicants_by_list(adf, ydf, jdf, 3, 5).collect()) == _best(scores, 3, 1, 0)


def test_cents_round_as_sql_does(spark):
    import numpy as np
    rnd = random.Random(1)
    v = [rnd.randint(0, 20000) / 200 for _ in range(2000)] + [rnd.uniform(-5, 100) for _ in range(2000)] + [0.285, 1.005, 2.675, 56.665, -0.125]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").selectExpr("cast(round(round(x, 2) * 100) as long)").collect()]
    assert mt._cents(np.array(v)).tolist() == want


def test_only_promising_lists_are_formed(spark):
    jobs = {j: (["sql", f"w{j}"] if j else ["sql"], None) for j in range(200)}
    jdf, adf, ydf = _frames(spark, jobs, {a: ["sql"] for a in range(5)}, dict.fromkeys(range(5)))
    seen = []
    real = mt.promising_lists
    try:
        mt.promising_lists = lambda *a: seen.append(real(*a).checkpoint()) or seen[-1]
        got = _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, 2).collect())
    finally:
        mt.promising_lists = real
    assert got == {a: [0, 1] for a in range(5)}
    assert seen[0].count() == 10            # two of the 200 lists that share a skill, for each applicant


def test_lists_that_tie_over_the_same_ids_are_told_apart(spark):
    """Lists of equal score whose ids interleave: their best jobs' ids decide, not their last ones."""
    vocab = [["sql", f"w{i}"] for i in range(60)]
    jobs = {j: (vocab[j % 60], (0.0, 3.0, 1.0)[j // 60 % 3]) for j in range(360)}
    apps, years = {a: ["sql"] for a in range(3)}, {0: None, 1: 0.0, 2: 5.0}
    excluded = {(0, 0), (1, 60), (1, 61), (2, 62)}
    jdf, adf, ydf = _frames(spark, jobs, apps, years)
    ex = spark.createDataFrame(sorted(excluded), "applicant_id long, job_id long")
    seen, real = [], mt.promising_lists
    try:
        mt.promising_lists = lambda *a: seen.append(real(*a).checkpoint()) or seen[-1]
        got = _per_group(mt.top_k_jobs_by_list(adf, ydf, jdf, 3, ex).collect())
    finally:
        mt.promising_lists = real
    assert got == _best(_all_scores(apps, jobs, years), 3, 0, 1, excluded)
    assert max(r["count"] for r in seen[0].groupBy("applicant_id").count().collect()) < 10      # 60 lists tie


def test_rows_joined_on_their_key_are_dealt_to_all_tasks(spark):
    """The join that makes the rows is partitioned on their key already; its output is small, the work on it is not."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = spark.range(400).selectExpr("id as lst", "id % 50 as w").groupBy("lst").agg(F.collect_list("w").alias("words"))
    required = spark.range(400).selectExpr("id as lst", "cast(id % 3 as double) as y").groupBy("lst").agg(
        F.collect_set(F.struct(F.col("y").cast("string").alias("rkey"), F.col("y").alias("req_years"))).alias("required"))
    lists = words.hint("merge").join(required, "lst").withColumn("n", F.lit(2))
    people = spark.range(100).selectExpr("xxhash64(id) as _key", "id as _id", "double(id % 9) as y", "array(id % 50) as words", "1L as size")
    top = mt.best_people(lists, people, 3)
    assert top.rdd.getNumPartitions() == n > 1 and top.count() == 800
    applicants = words.hint("merge").join(spark.range(400).selectExpr("id as lst", "double(id % 9) as y").groupBy("lst").agg(F.max("y").alias("y")), "lst")
    applicants = applicants.withColumnRenamed("lst", "applicant_id").withColumn("applied", F.array().cast("array<bigint>"))
    blocks = spark.range(50).selectExpr("id as _key", "2 as n", "array(id) as words", "1L as size", "1.0D as low", "false as any_null",
                                        "id as first", "id as last")
    assert mt.promising_lists(applicants, blocks, 3).rdd.getNumPartitions() == n
