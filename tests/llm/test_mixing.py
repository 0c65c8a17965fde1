import math
import random
import re
from fractions import Fraction

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import mixing as mx
from tests.llm.helpers import docs, edge_rows

SCHEMA = "doc_id long, text string, source string, size long, place long, target double, weight int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3.0, 4) for i, t, s in rows], SCHEMA)


def dealt(sizes: list[int], weights=(3, 1, 2)) -> list[Fraction]:
    """Dealing round by round, in fractions."""
    w = [weights[i % 3] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = Fraction(3 * sum(sizes), 2) - sum(2 * sizes[i] for i in full)
        rest = sum(w[i] for i in range(len(w)) if i not in full)
        share = [Fraction(2 * s) if i in full else left * w[i] / rest for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and share[i] > 2 * s}
        if not over:
            return share
        full |= over


def corpus(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    pick = lambda: rnd.choice(["hot"] * 4 + ["a", "b", "é", "\U0001f600", "￿", "", None, "Z"])
    return [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), pick()) for i in range(n)]


def check(rows: list[tuple], got: list) -> None:
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    target = dict(zip(names, dealt([total[s] for s in names]) if names else []))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    source, most = {i: s for i, _, s in rows}, {}
    for i, t, s in rows:
        most[s] = max(most.get(s, 0), size(t))
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in mine} == {total[s]} and all(math.isclose(r.target, target[s], abs_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= most[s] / 2 + 1e-6
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        if 1 <= target[s] / (total[s] or 1):
            assert all(r.taken >= r.size for r in mine)


def test_targets_and_taken_words(spark):
    for seed, n in ((1, 300), (2, 40), (3, 3), (4, 1)):
        rows = corpus(seed, n)
        check(rows, mx.mix(frame(spark, rows)).collect())


def test_reruns_and_layouts_agree(spark):
    rows = corpus(7, 200)
    first = sorted(map(tuple, mx.mix(frame(spark, rows)).collect()))
    assert first == sorted(map(tuple, mx.mix(frame(spark, rows[::-1]).repartition(7, "source")).collect()))


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mx, "STEP", 4)               # 15 levels of 16 buckets
    rows = corpus(11, 250)
    deep = sorted(map(tuple, mx.mix(frame(spark, rows)).collect()))
    monkeypatch.undo()
    assert deep == sorted(map(tuple, mx.mix(frame(spark, rows)).collect()))


def test_smaller_budgets_are_nested(spark):
    rows = corpus(13, 300)
    taken = []
    for share in ((1, 4), (1, 2), (1, 1), (3, 2)):
        taken.append({r.doc_id: r.taken for r in mx.mix(frame(spark, rows), share=share).collect()})
    assert all(a[i] <= b[i] for a, b in zip(taken, taken[1:]) for i in a)


def test_sql_agrees(spark, tmp_path):
    rows = corpus(17, 400) + [(1, "same text", "a")] * 5 + [(None, None, None), (None, "x y", None)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(mx.oracle()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in mx.mix(frame(spark, rows)).collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=9))
def test_dealing_ends_within_bounds(sizes):
    out = dealt(sizes)
    assert sum(out) == Fraction(3 * sum(sizes), 2) and all(t <= 2 * s for t, s in zip(out, sizes))


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    out = mx.mix(d).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert len({r.taken for r in out if r.doc_id == 4}) == 1
    assert mx.mix(d.limit(0)).count() == 0
    assert [(r.size, r.target, r.taken) for r in mx.mix(docs(spark, [(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2


def test_plan_is_native(spark):
    plan = mx.mix(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
