"""Ingestion helpers on literal rows."""

from pyspark.sql import functions as F

from jobloom.sources import ingest as ig


def test_defaults_and_keys(spark):
    df = spark.createDataFrame([("  ", "Acme", "Data Engineer"), (None, "Co", "Dev")], "loc string, co string, t string")
    rows = df.select(ig.default_if_blank(F.col("loc"), "No Location").alias("l"),
                     ig.doc_key(F.col("co"), F.col("t"), True).alias("k1"),
                     ig.doc_key(F.col("co"), F.col("t"), False).alias("k2")).collect()
    assert [(r.l, r.k1, r.k2) for r in rows] == [("No Location", "acme,data engineer", "Acme,Data Engineer"),
                                                  ("No Location", "co,dev", "Co,Dev")]


def test_record_form(spark):
    df = spark.createDataFrame([("T", None)], "title string, co string")
    got = df.select(ig.record_form([("Title", F.col("title")), ("Company", F.col("co"))])).first()[0]
    rule = "-" * 70 + "\n\n"
    assert got == "Title:\nT\n" + rule + "Company:\nNone\n" + rule


def test_label_export_last_wins_and_writeback(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, None, 3)], "id long, label int, seq long")
    assert {tuple(r) for r in ig.export_labels(labels, "id", "seq").collect()} == {(1, 1)}
    target = spark.createDataFrame([(1,), (3,)], "id long")
    wb = {r.id: r.labels_text for r in ig.write_back_labels(target, ig.export_labels(labels, "id", "seq"), "id").collect()}
    assert wb == {1: "[1]", 3: "[]"}


def test_writeback_keeps_old_labels(spark):
    target = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "id long, label int")
    wb = {r.id: r.labels_text for r in ig.write_back_labels(target, spark.createDataFrame([(3, 1)], "id long, label int"), "id").collect()}
    assert wb == {1: "[1]", 2: "[]", 3: "[1]"}
