"""Sources, sinks and the distributed sequence."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom.operators.sequence import with_sequence
from jobloom.sources import ingest as ig


def test_sequence_equals_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 50), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    got = with_sequence(df, ["k", "v"], "n", num_partitions=5)
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k", "v")))
    assert got.join(ref, ["k", "v"]).where("n != r").count() == 0
    assert sorted(r.n for r in got.collect()) == list(range(1, 3001))


def test_align_fields_lower_case_wins(spark):
    docs = spark.createDataFrame([("a", '{"Title": "Upper", "title": "lower", "Post Date": "x", "name": "Co"}')],
                                 "doc_id string, doc string")
    r = ig.align_fields(docs).first()
    assert r.Title == "lower" and r.Post_Date is None and r.Company_Name == "Co"


def test_insert_if_absent_is_idempotent(spark):
    target = spark.createDataFrame([("k1", 1)], "key string, v long")
    batch = spark.createDataFrame([("k1", 5), ("k2", 3), ("k2", 2)], "key string, v long")
    ins = ig.insert_if_absent(target, batch, "key", [F.col("v")])
    assert [tuple(r) for r in ins.collect()] == [("k2", 2)]
    again = ig.insert_if_absent(target.unionByName(ins), batch, "key", [F.col("v")])
    assert again.count() == 0


def test_hits_projection(spark):
    js = '{"hit":{"locations":[],"title":"T","company":{"name":"C","short_name":"c"},"short_title":"t","posted_at":"p"}}'
    df = spark.createDataFrame([(1, js), (2, "not json")], "hit_id long, json string")
    p = ig.parse_hits(df)
    rows = {r.hit_id: r for r in ig.project_hits(p, "https://b/").collect()}
    assert rows[1].location == "" and rows[1].link == "https://b/jobs/c/t" and rows[1].name == "C"
    assert {r.hit_id: r.s for r in p.select("hit_id", ig.malformed_reason(p).alias("s")).collect()} == {1: "ok", 2: "malformed"}
