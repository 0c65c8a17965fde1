"""The overlap-% variants on a job whose skill list has a duplicate, and complete results."""

import random
import re

import pytest

import __spark_entry__ as E
from jobloom.operators import overlap as ov
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text


def tables(spark, js, us, users, jobs):
    return (spark.createDataFrame(js, "job_id long, skill_id long"), spark.createDataFrame(us, "user_id long, skill_id long"),
            spark.createDataFrame([(u,) for u in users], "user_id long"), spark.createDataFrame([(j,) for j in jobs], "job_id long"))


def test_overlap_variants(spark):
    # job 1 lists skills [10, 10, 20, 30]; user 7 has {10, 40}; user 8 none
    js, us, users, jobs = tables(spark, [(1, 10), (1, 10), (1, 20), (1, 30)], [(7, 10), (7, 40)], [7, 8], [1])
    d = {r.user_id: r for r in ov.top_overlap(users, jobs, us, js, 5).collect()}
    assert (d[7].n_common, d[7].n_job_skills) == (1, 3) and abs(d[7].overlap_pct - 100 / 3) < 1e-9
    assert (d[8].n_common, d[8].n_job_skills, d[8].overlap_pct) == (0, 3, 0.0)
    a = ov.overlap_apply(spark.createDataFrame([(7, 1)], "user_id long, job_id long"), us, js).first()
    assert a.overlap_pct == 25.0          # distinct numerator, raw-list denominator
    c = {r.user_id: r.overlap_pct for r in ov.overlap_card(users, jobs, us, js).collect()}
    assert c == {7: 25.0, 8: 0.0}         # user-list entries found, raw-list denominator


def test_overlap_apply_without_common_skills(spark):
    js, us, _, _ = tables(spark, [(1, 10)], [(7, 99)], [], [])
    pairs = spark.createDataFrame([(7, 1), (7, 2)], "user_id long, job_id long")
    got = {r.job_id: r.overlap_pct for r in ov.overlap_apply(pairs, us, js).collect()}
    assert got == {1: 0.0, 2: 0.0}       # no skills listed for job 2 -> 0, like the guard


def test_shared_skills_of_pairs_keep_rows_and_repeats(spark):
    js, us, _, _ = tables(spark, [(1, 10), (1, 10), (1, 20), (2, None)], [(7, 10), (7, 40), (8, None)], [], [])
    pairs = spark.createDataFrame([(7, 1, 5), (7, 1, 6), (8, 1, 7), (None, 2, 8), (7, 3, 9), (9, None, 10)], "user_id long, job_id long, n long")
    got = {r.n: (r.shared, r.n_distinct, r.n_listed) for r in ov.with_shared_skills(pairs, us, js).collect()}
    assert got == {5: ([10], 2, 3), 6: ([10], 2, 3), 7: ([], 2, 3), 8: ([], 0, 1), 9: ([], None, None), 10: ([], None, None)}


@pytest.mark.parametrize("name", ["job_view_flags", "profile_applications", "skill_intersect", "overlap_apply"])
def test_applications_are_not_multiplied_by_skills(spark, name):
    plan = plan_text(E.queries()[name](spark, SF_SMALL))
    assert not re.search(r"(Left|Right) keys.*skill_id", plan)      # pairs met the skills one row each before


def test_all_users_and_jobs_against_brute_force(spark):
    rnd = random.Random(2)
    wanted = {j: [rnd.randrange(8) for _ in range(rnd.randint(0, 4))] for j in range(30)}
    have = {u: {rnd.randrange(10) for _ in range(rnd.randint(0, 3))} for u in range(12)}
    js, us, users, jobs = tables(spark, [(j, s) for j, ss in wanted.items() for s in ss], [(u, s) for u, ss in have.items() for s in ss], have, wanted)
    pct = {(u, j): 100.0 * len(h & set(w)) / len(set(w)) if w else 0.0 for u, h in have.items() for j, w in wanted.items()}
    for k in (1, 4, 35):
        got = {}
        for r in sorted(ov.top_overlap(users, jobs, us, js, k).collect(), key=lambda r: (r.user_id, r.rank)):
            got.setdefault(r.user_id, []).append(r.job_id)
        assert got == {u: sorted(wanted, key=lambda j: (-round(pct[u, j], 9), j))[:k] for u in have}
    counts = {(r.user_id, r.bucket): r.n_jobs for r in ov.bucket_counts(users, jobs, us, js).collect()}
    want = {}
    for (u, _), p in pct.items():
        b = "Strong Match" if p >= 70 else "Medium Match" if p >= 40 else "Weak Match"
        want[u, b] = want.get((u, b), 0) + 1
    assert counts == want
    shared = {r.user_id: (r.n_jobs_sharing, r.n_common_total, r.max_common) for r in ov.shared_counts(users, us, js).collect()}
    common = {u: [len(h & set(w)) for w in wanted.values()] for u, h in have.items()}
    assert shared == {u: (sum(c > 0 for c in cs), sum(cs), max(cs)) for u, cs in common.items()}


def test_blocks_of_any_size_give_one_result(spark):
    rnd = random.Random(5)
    wanted = {j: [rnd.randrange(40) for _ in range(rnd.randint(0, 9))] for j in range(300)}
    have = {u: {rnd.randrange(45) for _ in range(rnd.randint(0, 12))} for u in range(60)}
    js, us, users, jobs = tables(spark, [(j, s) for j, ss in wanted.items() for s in ss], [(u, s) for u, ss in have.items() for s in ss], have, wanted)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for fn in (lambda n: ov.top_overlap(users, jobs, us, js, 5, n), lambda n: ov.bucket_counts(users, jobs, us, js, n), lambda n: ov.shared_counts(users, us, js, n)):
        whole = rows(fn(4_000_000))
        assert rows(fn(100)) == whole and rows(fn(700)) == whole and whole
    pct = {(u, j): 100.0 * len(h & set(w)) / len(set(w)) if w else 0.0 for u, h in have.items() for j, w in wanted.items()}
    got = {}
    for r in sorted(ov.top_overlap(users, jobs, us, js, 5, 100).collect(), key=lambda r: (r.user_id, r.rank)):
        got.setdefault(r.user_id, []).append(r.job_id)
    assert got == {u: sorted(wanted, key=lambda j: (-round(pct[u, j], 9), j))[:5] for u in have}


def test_prefix_filter_finds_what_a_full_count_finds(spark):
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(6)
    sets = [sorted(rnd.sample(range(30), rnd.randint(1, 8))) for _ in range(400)]
    block = ov.SkillSets(pa.table({"_key": range(400), "n_jobs": [1] * 400, "first_job": range(400), "set": pa.array(sets, pa.list_(pa.int64()))}))
    for _ in range(60):
        mine = np.array(rnd.sample(range(35), rnd.randint(0, 10)), np.int64)
        found, count = block.common(mine)
        assert dict(zip(found.tolist(), count.tolist())) == {i: c for i, s in enumerate(sets) if (c := len(set(s) & set(mine.tolist())))}
        for least in (20.0, 100 / 3, 50.0, 70.0, 100.0):
            keep = block.share(count, found) >= least
            got = block.common(mine, least)
            assert got[0].tolist() == found[keep].tolist() and got[1].tolist() == count[keep].tolist()


def test_users_and_sets_do_not_meet_in_a_shuffle(spark):
    js, us, users, jobs = tables(spark, [(1, 10)], [(7, 10)], [7], [1])
    plan = ov.shared_counts(users, us, js)._jdf.queryExecution().executedPlan().toString()
    assert "sid" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_match_bucket(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (0.0,)], "p double")
    got = [r[0] for r in df.select(ov.match_bucket(df.p)).collect()]
    assert got == ["Strong Match", "Medium Match", "Medium Match", "Weak Match"]


def test_hits_of_a_batch_are_counted_in_parts(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(8)
    sets = [sorted(rnd.sample(range(30), rnd.randint(1, 8))) for _ in range(300)]
    block = ov.SkillSets(pa.table({"_key": range(300), "n_jobs": [1] * 300, "first_job": range(300), "set": pa.array(sets, pa.list_(pa.int64()))}))
    users = [rnd.sample(range(35), rnd.randint(0, 10)) for _ in range(80)] + [[], [99]]
    want = {(u, i): c for u, mine in enumerate(users) for i, x in enumerate(sets) if (c := len(set(x) & set(mine)))}
    for hits in (1, 500, 10**6):
        monkeypatch.setattr(ov, "HITS", hits)
        parts = list(block.meet(pa.array(users, pa.list_(pa.int64()))))
        row, found, count = (np.concatenate(x).tolist() for x in zip(*parts))
        assert dict(zip(zip(row, found), count)) == want and len(row) == len(want)
        assert len(parts) == 1 if hits == 10**6 else len(parts) > 5
