"""Keyed updates, bucketed lookups, day partitions and ordered admission."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from jobloom.sources import days, keyed
from jobloom.sources import ingest as ig
from tests.test_plans import plan_text


def files(path) -> dict[str, set]:
    out = {}
    for f in Path(path).rglob("part-*.parquet"):
        out.setdefault(f.parent.name, set()).add(f.name)
    return out


def test_update_rewrites_its_buckets_alone_and_keeps_old_values(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(i, f"n{i}", [1] if i % 2 else []) for i in range(200)], "id long, name string, labels array<int>"), path, "id")
    before = files(path)
    assert len(before) > 30 and all(len(f) == 1 for f in before.values())
    ig.update_labels(path, spark.createDataFrame([(4, 0), (5, None), (9999, 1)], "id long, label int"), "id")
    after, rows = files(path), {r.id: (r.name, r.labels) for r in keyed.read(spark, path).collect()}
    assert rows == {i: (f"n{i}", [0] if i == 4 else [1] if i % 2 else []) for i in range(200)}
    touched = {f"_bucket={r[0]}" for r in spark.createDataFrame([(4,), (9999,)], "id long").select(keyed._bucket("id", keyed.BUCKETS)).collect()}
    assert {b for b in before if before[b] != after.get(b)} <= touched and before != after
    # a second write-back leaves the first one's labels
    ig.update_labels(path, spark.createDataFrame([(6, 1)], "id long, label int"), "id")
    rows = {r.id: r.labels for r in keyed.read(spark, path).collect()}
    assert rows[4] == [0] and rows[6] == [1] and rows[7] == [1] and len(rows) == 200


def test_replace_by_owner(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(u, s) for u in range(40) for s in range(3)], "u long, s long"), path, "u")
    owners = spark.createDataFrame([(1,), (2,), (2,), (77,)], "u long")
    keyed.replace_by_owner(spark, path, owners, spark.createDataFrame([(1, 9), (77, 5), (3, 8)], "u long, s long"), "u")
    got = sorted(map(tuple, keyed.read(spark, path).collect()))
    assert got == sorted([(u, s) for u in range(40) if u not in (1, 2) for s in range(3)] + [(1, 9), (77, 5)])


def test_a_bucket_can_lose_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(1, 1), (2, 2)], "u long, s long"), path, "u")
    none = spark.createDataFrame([], "u long, s long")
    keyed.replace_by_owner(spark, path, spark.createDataFrame([(1,)], "u long"), none, "u")
    assert [tuple(r) for r in keyed.read(spark, path).collect()] == [(2, 2)]


def test_bucketed_lookup_moves_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "id long, name string")
    keys = spark.createDataFrame([(5,), (500,), (7,), (5,)], "id long")
    t = keyed.create_bucketed(rows, str(tmp_path / "rows"), "lookup_test_rows", "id", 8)
    k = keyed.create_bucketed(keys, str(tmp_path / "keys"), "lookup_test_keys", "id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keyed.lookup(t, k, "id")
        assert sorted(map(tuple, out.collect())) == [(5, "n5", True), (7, "n7", True), (500, None, False)]
        assert "Exchange" not in plan_text(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table lookup_test_rows")
        spark.sql("drop table lookup_test_keys")


def test_day_partitions_are_pruned_and_bounds_are_inclusive(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i)) for i in range(240)] + [(1000, None)]
    path = str(tmp_path / "d")
    days.create(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), path, "ts")
    lit = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    lo, hi = base + dt.timedelta(hours=30), base + dt.timedelta(hours=72)
    out = days.time_range(spark, path, "ts", lit(lo), lit(hi))
    assert sorted(r.id for r in out.collect()) == list(range(30, 73))
    p = plan_text(out)
    assert "PartitionFilters: [isnotnull(_day" in p and "_day" in p.split("PartitionFilters")[1][:120]
    days.create(spark.createDataFrame([(2000, lo)], "id long, ts timestamp_ntz"), path, "ts", "append")
    assert 2000 in {r.id for r in days.time_range(spark, path, "ts", lit(lo), lit(hi)).collect()}


def sequential(new, old, skills):
    names, mails, known, out = {u for u, _ in old}, {e for _, e in old}, {s.lower() for s in skills}, {}
    for i, u, e, s in sorted(new):
        if u in names and u is not None:
            out[i] = "Username already exists"
        elif e in mails and e is not None:
            out[i] = "Email already exists"
        else:
            names.add(u)
            mails.add(e)
            out[i] = "Skill name is required" if not s.strip() else "Skill already exists" if s.lower() in known else "ok"
            if s.strip():
                known.add(s.lower())
    return out


def admitted(spark, new, old, skills):
    n = spark.createDataFrame(new, "id long, username string, email string, skill string").repartition(3)
    o = spark.createDataFrame(old, "username string, email string")
    k = spark.createDataFrame([(s,) for s in skills], "skill string")
    return {r.id: r.reason for r in ig.registration_reasons(n, o, k, "id").collect()}


def test_registrations_one_after_another(spark):
    # a chain: each waits for the one before, by name and by mail in turn
    chain = [(i, f"u{i // 2}", f"m{(i + 1) // 2}", "x") for i in range(14)]
    assert admitted(spark, chain, [], []) == sequential(chain, [], [])
    twice = [(1, "bob", "a", "s1"), (2, "bob", "b", "s2"), (3, "eve", "a", "s3"), (4, "eve", "c", "S1"), (5, None, None, ""), (6, None, None, "s9")]
    got = admitted(spark, twice, [], ["s9"])
    assert got == sequential(twice, [], ["s9"]) and got[1] == "ok" and got[2] == "Username already exists" and got[3] == "Email already exists"
    rnd = random.Random(3)
    for n in (6, 30):
        pick = lambda p: rnd.choice([None] + [f"{p}{rnd.randrange(n)}" for _ in range(12)])
        new = [(i, pick("u"), pick("m"), rnd.choice(["", " ", "sql", "SQL", "go", "r"])) for i in range(80)]
        old = [(pick("u"), pick("m")) for _ in range(4)]
        assert admitted(spark, new, old, ["go"]) == sequential(new, [o for o in old], ["go"])
