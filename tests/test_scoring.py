"""Scoring expressions against a plain-Python statement of the rules, plus the golden
sample-ATS table."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import scoring as sc
from jobloom.operators import matching as mt


def spec_years(s):
    parts = s.split()
    if not parts:
        return None
    try:
        return float(parts[0])
    except ValueError:
        return None


def expected_experience(have, need):
    """Half marks when either side is unknown, full marks when enough, the covered share otherwise."""
    if have is None or need is None:
        return 50.0
    return min(have / need, 1.0) * 100.0 if need > have else 100.0


def expected_skills(offered, asked):
    """Share of the asked entries that name, or are named by, something offered."""
    clean = lambda xs: [x.strip().lower() for x in xs]
    offered, asked = clean(offered), clean(asked)
    met = [any(o in x or x in o for o in offered) for x in asked]
    return 100.0 * sum(met) / len(met) if met else 100.0


def test_parse_years(spark):
    rows = [("6 years",), ("5+ years",), ("5-10 years",), ("",), ("  3.5 yrs",), ("1e1 years",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(sc.parse_years("x")).collect()]
    assert got == [6.0, None, None, None, 3.5, 10.0, None]


def test_experience_pct(spark):
    rows = [(6.0, 5.0), (2.0, 4.0), (None, 3.0), (3.0, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, r double")
           .select(sc.experience_match_pct("a", "r")).collect()]
    assert got == [100.0, 50.0, 50.0, 50.0] == [expected_experience(*r) for r in rows]


words = st.lists(st.sampled_from(["py", "python", "sql", "c++", "", " Go ", "go lang", "ml", "x"]), max_size=5)


@settings(max_examples=40, deadline=None)
@given(app=words, job=words)
def test_skill_pct_matches_spec(spark, app, job):
    df = spark.createDataFrame([(app, job)], "a array<string>, j array<string>")
    got = df.select(sc.skill_match_pct(sc.as_skill_list("a", None), sc.as_skill_list("j", None))).first()[0]
    assert math.isclose(got, expected_skills(app, job))


def test_comma_string_quirks(spark):
    df = spark.createDataFrame([("python, sql", ""), ("", "python, sql"), ("python", "Python,Git")], "a string, j string")
    got = [r[0] for r in df.select(sc.skill_match_pct(sc.as_skill_list("a"), sc.as_skill_list("j"))).collect()]
    # an empty job string is one empty skill (a substring of anything); an empty applicant
    # string likewise matches every job skill
    assert got == [100.0, 100.0, 50.0]


def test_levenshtein_ratio(spark):
    df = spark.createDataFrame([("pytorch", "torch")], "a string, b string")
    r = df.select(F.levenshtein("a", "b"), sc.levenshtein_ratio("a", "b")).first()
    assert r[0] == 2 and round(r[1], 3) == 0.714


def test_binary_softmax_and_dot(spark):
    df = spark.createDataFrame([(2.0, 0.0, [1.0, 2.0], [3.0, 4.0])], "y double, n double, a array<double>, b array<double>")
    r = df.select(sc.binary_softmax("y", "n"), sc.dot("a", "b")).first()
    assert math.isclose(r[0], math.exp(2) / (math.exp(2) + 1)) and r[1] == 11.0


# A small board of our own: what each posting asks for and what each person offers.
POSTINGS = [(1, ["welding", "blueprint reading", "safety"], 4.0), (2, ["safety", "forklift"], None), (3, ["accounting", "excel"], 2.0),
            (4, [], 10.0), (5, ["excel"], 5.0)]
PEOPLE = [(100, ["weld", "safety"], 6.0), (101, ["advanced excel", "accounting"], 1.0), (102, ["painting"], None)]
# by hand: 0.6 * share of asked skills met + 0.4 * (100, or years over years asked, or 50 if either is unknown)
SCORES = {100: {1: 80.0, 2: 50.0, 3: 40.0, 4: 84.0, 5: 40.0}, 101: {1: 10.0, 2: 20.0, 3: 80.0, 4: 64.0, 5: 68.0},
          102: {1: 20.0, 2: 20.0, 3: 20.0, 4: 80.0, 5: 20.0}}


def _frames(spark):
    jobs = spark.createDataFrame(POSTINGS, "job_id long, skills array<string>, req_years double")
    skills = spark.createDataFrame([(p, s) for p, ss, _ in PEOPLE for s in ss], "applicant_id long, skill string")
    years = spark.createDataFrame([(p, y) for p, _, y in PEOPLE], "applicant_id long, years double")
    return jobs, skills, years


def test_jobs_for_people_by_hand(spark):
    jobs, skills, years = _frames(spark)
    for k in (1, 2, 5):
        got = {}
        for r in sorted(mt.top_k_jobs_by_list(skills, years, jobs, k).collect(), key=lambda r: (r.group_id, r.rank)):
            got.setdefault(r.group_id, []).append((r.item_id, r.match_score))
        assert got == {p: sorted(row.items(), key=lambda x: (-x[1], x[0]))[:k] for p, row in SCORES.items()}


def test_people_for_jobs_by_hand(spark):
    jobs, skills, years = _frames(spark)
    got = {}
    for r in sorted(mt.top_k_applicants_by_list(skills, years, jobs, 2).collect(), key=lambda r: (r.group_id, r.rank)):
        got.setdefault(r.group_id, []).append((r.item_id, r.match_score))
    assert got == {j: sorted(((p, row[j]) for p, row in SCORES.items()), key=lambda x: (-x[1], x[0]))[:2] for j in range(1, 6)}
