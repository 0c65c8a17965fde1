"""Stored searches and many similarity queries against the direct forms."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.operators import search as se
from jobloom.operators import similar as sm
from tests.test_plans import plan_text


def corpus(seed):
    rnd = random.Random(seed)
    words = ["Blue", "anvil", "gear", "red", "a.b", "C++", "x_y", "100%", "brand#12", "ÉTÉ", "été"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(120)] + [(500, None), (501, "")]


def frames(spark, texts, searches):
    return (spark.createDataFrame(list(enumerate(searches)), "search_id long, q string"), spark.createDataFrame(texts, "id long, text string"))


def test_like_searches(spark):
    texts = corpus(1)
    searches = ["blue", "BLUE anv", "a", "", "%", "_", "x_y", "x\\_y", "100\\%", "r%d", "ue a_vil", "zzz", "zz%blue", "été", "gear red gear", "b.", None]
    s, t = frames(spark, texts, searches)
    want = {tuple(r) for r in s.join(t, F.expr("ilike(text, concat('%', q, '%'))")).select("search_id", "id").collect()}
    found = se.search_like(s, t)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 300
    assert "NestedLoop" not in plan_text(found) and "Cartesian" not in plan_text(found)


def test_regex_searches(spark):
    texts = corpus(2)
    searches = ["blue (anvil|gear)", "blue|red", "gea?r", "an+vil", "c\\+\\+", "[ab]nvil", "^blue", "red$", "b.ue", "", "a|", "brand#1[0-9]", "(?s)red.*gear",
                "gear{1,2} re*d", "(ge(a)r )+red", "zzz|yyy", "\\bred\\b", "x_y", "anvil gear|^$", "\\Qa.b\\E", "ab*", "été", None]
    s, t = frames(spark, texts, searches)
    want = {(i, j) for i, q in enumerate(searches) if q is not None and "\\Q" not in q for j, x in texts if x is not None and re.search("(?i)" + q if not q.startswith("(?s)") else q[:4].replace("s", "si") + q[4:], x)}
    got = {tuple(r) for r in se.search_regex(s, t).collect()}
    assert {p for p in got if searches[p[0]] not in ("\\Qa.b\\E", "été")} == {p for p in want if searches[p[0]] != "été"}
    direct = {tuple(r) for r in s.join(t, F.expr("text rlike concat('(?i)', q)")).select("search_id", "id").collect()}
    assert got == direct and len(direct) > 300


@pytest.mark.parametrize("search,test", [(se.search_like, "ilike(text, concat('%', q, '%'))"), (se.search_regex, "text rlike concat('(?i)', q)")])
def test_hits_of_equal_searches_in_equal_texts(spark, search, test):
    texts = corpus(4) * 3
    s, t = frames(spark, [(i, x) for i, (_, x) in enumerate(texts)], ["blue", "red", "blue", "", None, "zzz", "a.b", "blue"])
    want = {r.search_id: (r.n, r.first) for r in s.join(t, F.expr(test), "left").groupBy("search_id").agg(F.count("id").alias("n"), F.min("id").alias("first")).collect()}
    pairs = []
    got = {r.search_id: (r.n_hits, r.first_id) for r in se.hits_per_search(s, t, lambda a, b: pairs.append((a.count(), b.count())) or search(a, b)).collect()}
    assert got == want and got[0] == got[2] and got[4] == (0, None)
    assert pairs == [(5, len({x for _, x in texts if x is not None}))]          # each different pair is looked at once


def test_postings_hold_only_asked_grams(spark):
    s, t = frames(spark, corpus(3), ["blue"])
    keys = se.like_keys(F.col("q"))
    assert s.select(keys.alias("k")).first().k == [["blu", "lue"]]


@pytest.mark.parametrize("block,head", [(1024, 8192), (7, 5), (3, 50)])
def test_top_similar_against_all_products(spark, block, head):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(900, 12)) * rnd.uniform(0.01, 3, (900, 1))
    v[50:90] = v[50]                                    # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 12), (2002, [1.0])]
    items = sm.by_norm(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 5)
    queries = spark.createDataFrame([r for r in rows if r[0] % 30 == 0], "id long, vec array<double>")
    got = {}
    for r in sm.top_similar(queries, items, 6, 6, block, head).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    full = {i: np.pad(np.array(x), (0, 12 - len(x))) for i, x in rows if x is not None}
    for q in (i for i, x in rows if i % 30 == 0 and x is not None):
        want = sorted(((-round(float(full[q] @ x), 6), i) for i, x in full.items() if i != q))[:6]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s)) for s, i in want]


def test_tiles_that_cannot_matter_are_left(spark):
    v = np.zeros((6000, 4))
    v[:, 0] = np.linspace(10, 0.001, 6000)
    items = sm.by_norm(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", 2)
    tiles = sm._best(items, np.array([[1.0, 0, 0, 0]]), np.array([9.9]), 3, 6).where("q < 0").agg(F.sum("id")).first()[0]
    assert tiles == 1                                   # of 6
