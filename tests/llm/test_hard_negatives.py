import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, slot long, anchor long"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 150), st.integers(1, 90), st.integers(1, 150), st.integers(0, 9))
def test_strassen_is_exact(m, k, n, seed):
    rnd = np.random.default_rng(seed)
    a, b = rnd.integers(-(1 << 26), 1 << 26, (m, k)), rnd.integers(-(1 << 26), 1 << 26, (k, n))
    want = a.astype(object) @ b.astype(object)
    assert (hn.strassen(a, b).astype(object) == want).all()


def brute(rows: list[tuple], every: int, positives: int = 5, negatives: int = 10) -> list[tuple]:
    """All pairs, Python integers: (vec_id, vector, label) rows."""
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows
           if g is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (i, v, g) in enumerate(use):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, h, b) for b, (j, w, h) in enumerate(use) if b != a]
        for p, j, _, _ in sorted((s for s in scores if s[2] == g), key=key)[:positives]:
            hits = sorted((s for s in scores if s[2] != g and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:negatives]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(hits, 1)]
    return sorted(out, key=repr)


def run(spark, rows, every, **kw):
    d = spark.createDataFrame([(i, v, g, 1, 2, 3) for i, v, g in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in hn.mine(hn.usable(d), F.col("vec_id") % every == 0, **kw).collect()), key=repr)


def vectors(seed: int, n: int, width: int = 8, labels: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    out = []
    for i in range(n):
        v = [x + rnd.gauss(0, 0.4) for x in rnd.choice(base)]
        out.append((i, [round(x * 4) / 4 for x in v] if rnd.random() < 0.5 else v, rnd.randrange(labels)))
    return out


@pytest.mark.parametrize("anchors,tile", [(8192, 512), (7, 512), (8192, 16)])
def test_against_brute_force(spark, monkeypatch, anchors, tile):
    monkeypatch.setattr(hn, "TILE", tile)
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[0][1], 1) for i in range(120)]                  # one vector in many rows: ties by id
    rows += [rows[10], rows[10], rows[13]]                                   # repeated rows, anchors among them
    want = brute(rows, 10)
    assert run(spark, rows, 10, anchors=anchors) == want and len(want) > 1000


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60) + [(100, None, 1), (110, [1.0, None], 1), (120, [nan, 1.0], 1), (130, [inf, 1.0], 2), (140, [1.0] * 8, None),
                             (None, [0.5] * 8, 1), (None, [0.25] * 8, 2), (150, [], 1), (160, [1.0], 2), (170, [0.5] * 12, 0), (180, [0.0] * 8, 1)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_bound_of_components():
    import pyarrow as pa
    v = pa.array([[1e30, -1e30, 0.3], [1.0], [-0.001, 0.001, 2.0]], pa.list_(pa.float64()))
    assert hn.whole_components(v, 3).tolist() == [[1 << 26, -(1 << 26), 76], [256, 0, 0], [-1, 0, 512]]
    assert hn.whole_components(v, 2).tolist() == [[1 << 26, -(1 << 26)], [256, 0], [-1, 0]]


def test_no_anchors_and_empty(spark):
    assert run(spark, vectors(3, 9)[1:], 100) == [] and run(spark, [], 1) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 2)], 1) == []               # no positives
