import duckdb

from jobloom.llm import licences as lc
from tests.llm.helpers import docs, edge_rows


def test_variants_of_whole_texts(spark):
    rows = []
    for i, (_, t) in enumerate(lc.TEXTS):
        rows.append((i, "Copyright (c) 2020 Foo Bar\n\n© Baz 1999\n" + t.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ,").replace(" OF ", "\n OF  ")))
    out = {r.doc_id: r for r in lc.scan(docs(spark, rows)).collect()}
    assert all(out[i].license_id == lc.TEXTS[i][0] for i in out)
    changed = lc.scan(docs(spark, [(1, lc.MIT.replace("free of charge", "for a fee")), (2, lc.MIT + " More.")])).collect()
    assert all(r.license_id is None for r in changed)


def test_notices_are_whole_lines(spark):
    text = "Some prose.\n  Released under the MIT Licence!\nAll rights reserved.\nReleased under the MIT License, and more."
    r = lc.scan(docs(spark, [(1, text)])).first()
    assert r.notices == "MIT,all-rights-reserved" and r.license_id is None


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    out = lc.scan(d).collect()
    assert len(out) == len(edge_rows()) and all(r.license_id is None and r.notices == "" for r in out)
    assert len({r.digest for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert lc.scan(d.limit(0)).count() == 0


def test_against_sql(spark, tmp_path):
    texts = [(i, t) for i, (_, t) in enumerate(lc.TEXTS)] + [(100 + i, "Copyright 2001 X\n" + t + "\nAll rights reserved.") for i, (_, t) in enumerate(lc.TEXTS)]
    texts += [(300, "(c) 2011 me\n©\nline\r\nAll rights   reserved"), (301, "Çtre licencé – (C) 1999"), (302, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(map(repr, con.execute(lc.oracle()).fetchall()))
    got = sorted(repr(tuple(r)) for r in lc.scan(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == want


def test_plan_is_native(spark):
    plan = lc.scan(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entire_licences_and_own_texts(spark):
    full = {p.stem: p.read_text("utf-8") for p in (lc.Path(lc.__file__).parent / "licence_texts").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(full)
    names = sorted(full)
    rows = [(i, full[n]) for i, n in enumerate(names)] + [(100, "Use it\n as you LIKE, friend"), (101, full["GPL-3.0"] + " More.")]
    own = spark.createDataFrame([("Own-1", "Copyright (c) 2020 A\nUse it as you like, friend."), ("none", ""), ("none", None)], "license_id string, text string")
    out = {r.doc_id: r.license_id for r in lc.scan(docs(spark, rows), own).collect()}
    assert out == {**dict(enumerate(names)), 100: "Own-1", 101: None}
    assert {r.doc_id: r.license_id for r in lc.scan(docs(spark, rows)).collect()} == {**dict(enumerate(names)), 100: None, 101: None}
