"""Relevance model pipeline and the pluggable batch encoder."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from jobloom.operators import relevance as rel


def hashing_encoder(texts):
    """A stand-in embedding model: bag of hashed words in 16 dimensions, unit length."""
    out = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % 16] += 1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def test_encode_with_batches(spark):
    docs = spark.createDataFrame([(i, f"python sql job {i}") for i in range(50)], "doc_id long, text string")
    enc = rel.encode_with(docs.repartition(3), "doc_id", "text", "hashing", lambda: hashing_encoder)
    rows = enc.collect()
    assert len(rows) == 50 and all(len(r.embedding) == 16 for r in rows)
    assert abs(sum(x * x for x in rows[0].embedding) - 1.0) < 1e-9


def test_relevance_model_separates_labels(spark):
    rows = [(i, "python sql spark data engineer", 1) for i in range(20)] + \
           [(100 + i, "forklift warehouse night shift", 0) for i in range(20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = rel.fit_relevance(train, "text", "label")
    scored = rel.score_relevance(model, train, "doc_id").join(train, "doc_id")
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("p_yes").alias("m")).collect()}
    assert means[1] > 0.8 > 0.2 > means[0]


def _weights(model):
    lr = model.stages[-1]
    return lr.coefficients.toArray(), lr.intercept


def _training(spark):
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words[:25] if i % 3 else words[10:]) for _ in range(rnd.randint(1, 30))), int(i % 3 == 0)) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_gradient_vanishes_at_the_fit(spark):
    """Mean log loss plus 0.005 |w / std|^-2 ... : the penalty acts on standardised weights, so its gradient is lambda std^2 w."""
    train = _training(spark)
    model = rel.fit_relevance(train, "text", "label")
    rows = model.transform(train.withColumn("label", F.col("label").cast("double"))).select("features", "label").collect()
    x = np.array([r.features.toArray()[np.flatnonzero(_weights(model)[0])] for r in rows])
    y = np.array([r.label for r in rows])
    w, b = _weights(model)
    w = w[np.flatnonzero(w)]
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = x.T @ (p - y) / len(y) + 0.01 * x.std(0, ddof=1) ** 2 * w
    assert np.abs(gradient).max() < 2e-3 and abs((p - y).mean()) < 2e-3


def test_scores_from_the_saved_weights(spark, tmp_path):
    """P(relevant) recomputed from the saved model's tables: hashed term counts, inverse document frequencies, weights."""
    train = _training(spark)
    path = str(tmp_path / "model")
    model = rel.fit_relevance(train, "text", "label", path)
    from pyspark.ml import PipelineModel
    loaded = PipelineModel.load(path)
    idf = loaded.stages[3].idf.toArray()
    w, b = _weights(loaded)
    for r in model.transform(train).select("_words", "_tf", "probability").collect():
        counts = {int(i): float(v) for i, v in zip(r._tf.indices, r._tf.values)}
        assert sum(counts.values()) == len(r._words)
        z = b + sum(v * idf[i] * w[i] for i, v in counts.items())
        assert abs(1 / (1 + np.exp(-z)) - r.probability[1]) < 1e-9
    # the inverse document frequencies by hand
    n, df = train.count(), {}
    for r in model.transform(train).select("_tf").collect():
        for i in r._tf.indices:
            df[int(i)] = df.get(int(i), 0) + 1
    assert all(abs(idf[i] - np.log((n + 1) / (k + 1))) < 1e-9 for i, k in df.items())


def test_texts_are_cut_once_for_fit_and_scores(spark):
    from types import SimpleNamespace

    from jobloom.plans.relevance import model_ranking
    train = _training(spark)
    texts = train.select("doc_id", "text").localCheckpoint()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    docs = texts.mapInArrow(counted, "doc_id long, text string")
    labels = train.where("doc_id < 120").select("doc_id", F.col("label").alias("quality"))
    got = {r.doc_id: (r.rank, r.score) for r in model_ranking(spark, SimpleNamespace(documents=docs, labels=labels)).collect()}
    assert read.value == 150
    model = rel.fit_relevance(texts.join(labels, "doc_id").withColumnRenamed("quality", "label"), "text", "label")
    want = {r.doc_id: r.p_yes for r in rel.score_relevance(model, texts, "doc_id").collect()}
    assert set(got) == set(want) and all(abs(got[i][1] - want[i]) < 1e-6 for i in want)
    assert [r for r, _ in sorted(got.values())] == list(range(150))
