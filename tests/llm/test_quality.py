import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import quality as q
from tests.llm.helpers import PROSE, docs, edge_rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n#|é\xa0\t", max_size=120))
def test_statistics_against_brute_force(text):
    assert q.rule_stats(text)[0] == brute(text)


def test_windows_repeat():
    text = " ".join([PROSE, PROSE])
    assert q.rule_stats(text)[0] == brute(text) and q.rule_stats(text)[0][4] == len(text.split())


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 0.02, (400, 4)), rng.normal(1, 0.02, (20, 4))
    f = q.grow_forest(good, bad)
    s = f.score(np.concatenate([good, bad]))
    f.threshold = q.calibrate(s, np.arange(420) >= 400)
    assert (s[400:] >= f.threshold).all() and (s[:400] < f.threshold).mean() > 0.99


def test_threshold_keeps_ties_together():
    t = q.calibrate(np.array([.9, .9, .5, .5]), np.array([True, False, False, False]), cost=0.1)
    assert t < .9 or t > .9


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    out = q.judge(d, None).collect()
    assert len(out) == len(edge_rows())
    assert {r.doc_id: r.n_words for r in out if r.doc_id}[6] == 30_000
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3, 7, 9))
    assert [r.kept for r in out if r.doc_id == 4] == [True, True]
    assert q.judge(d.limit(0), None).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert q.fit(d, labels) is None
    kept = q.keep(d, None)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in out)


def test_labelled_rows_reject_like_kinds(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    prose = [" ".join(rng.choice(vocabulary, 60)) for _ in range(150)]
    junk = [" ".join(w + "***" for w in rng.choice(vocabulary, 60)) for _ in range(30)]
    d = docs(spark, list(enumerate(prose + junk)))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(180) if i % 2], "doc_id bigint, quality int, toxic int")
    verdict = {r.doc_id: r.kept for r in q.judge(d, q.fit(d, labels)).collect()}
    assert sum(verdict[i] for i in range(150)) >= 147 and not any(verdict[i] for i in range(150, 180))


def test_scales_and_threshold_count_every_row(spark):
    """More rows than the former bound of 6000; quantiles and threshold against plain numpy over all of them."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.gamma(2, 1, (9000, 2)), [[50.0, 3.0]] * 400])
    bad = np.arange(len(x)) >= 9000
    rows = spark.createDataFrame([(r.tolist(), bool(b), i) for i, (r, b) in enumerate(zip(x, bad))], "f array<double>, bad boolean, same bigint")
    got = q.quantiles(rows.where("not bad"), [0.01, 0.5, 0.99])
    want = np.quantile(x[:9000], [0.01, 0.5, 0.99], axis=0, method="inverted_cdf")
    assert np.abs(got - want).max() < 1e-5
    samples = q.tree_rows(rows, 0.5, 9200, 256)
    assert len(samples) == q.TREES and all(len(s) == 256 for s in samples)
    assert len({tuple(r) for s in samples for r in s.tolist()}) > 7000         # the trees draw from all rows, not from one small part
    forest = q.grow_trees(samples, got[1], got[0], got[2], np.random.default_rng(7))
    whole = q.calibrate(forest.score(x), bad)
    forest.threshold = q.threshold(rows, forest)
    assert abs(forest.threshold - whole) < 0.02 and (forest.score(x[bad]) >= forest.threshold).all()
