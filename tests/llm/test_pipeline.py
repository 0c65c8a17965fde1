from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as cp
from jobloom.llm import decontaminate, packing, pii, quality, simhash
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, edge_rows

OPERATORS = range(1, 14)


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in OPERATORS)
    assert set(E.oracle_sql()) <= set(names)


def test_stages_against_their_operators(spark):
    """Each stage on the one before, held against the operator's own verdict on the same rows."""
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = d.columns, d
    for name, stage in cp.STAGES:
        after = stage(spark, before, SF_SMALL)
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        old = {r.doc_id: r.text for r in before.collect()}
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
            assert ids == {r.doc_id for r in quality.judge(before, quality.fit(before, labels)).where("kept").collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            sound = {r.doc_id for r in quality.judge(before, None).where("not base_failed").collect()} & good
            assert len(sound - ids) <= 0.02 * len(sound)
        elif name == "near_dedup":
            fps = {i: simhash.fingerprint(t) % (1 << 64) for i, t in old.items()}
            for i in old:           # a document that goes has a smaller one near it; no two near ones stay
                near = [j for j in old if j != i and bin(fps[i] ^ fps[j]).count("1") <= 4]
                assert i in ids or near
                assert not (i in ids and any(j in ids for j in near))
        elif name == "decontamination":
            found = decontaminate.blocks(before, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
            assert ids == set(old) - {r.doc_id for r in decontaminate.contaminated(before, found).collect()}
        elif name == "redaction":
            assert ids == set(old)
            left = {r.doc_id: r.text for r in after.collect()}
            for i, t in old.items():
                spans = pii.base_spans(t or "")
                assert not pii.base_spans(left[i] or "") and (spans or left[i] == t or "[" in left[i])
        else:
            assert ids == set(old)
            assert after.agg(F.sum("length")).first()[0] == packing.pieces(before).agg(F.sum("length")).first()[0]
        if name != cp.STAGES[-1][0]:
            assert after.columns == columns
        before = after.cache()


def test_stages_take_edge_rows_and_empty_tables(spark):
    for rows in (edge_rows(), []):
        d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "fp", "node", "kept", "sig")
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, d, SF_SMALL)
            assert out.columns == d.columns and out.count() <= len(rows)
        assert cp.STAGES[-1][1](spark, d, SF_SMALL).count() >= len(rows)
