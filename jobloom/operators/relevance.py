"""Binary relevance model over posting text, as a Spark ML pipeline.

Tokenise -> drop stop words -> hashed term counts -> IDF -> logistic regression.
Training and scoring are distributed; the fitted model is saved to the shared
checkpoint folder so a scoring job can load it instead of refitting.  Cutting the texts is most
of the work: :func:`term_counts` does it once for the passes of fitting and scoring.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from ..session import shared_dir

NUM_FEATURES = 1 << 18


def _terms(text_col: str) -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=tx.RE_TOKEN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_words", stopWords=cat.KEYWORD_STOP_WORDS),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=NUM_FEATURES),
    ]


def _features(text_col: str) -> list:
    return [*_terms(text_col), IDF(inputCol="_tf", outputCol="features")]


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the hashed term counts ``_tf`` in place of the text, written once in the shared folder."""
    rows = PipelineModel(_terms(text_col)).transform(docs).drop(text_col, "_tok", "_words")
    path = shared_dir(docs.sparkSession, f"term-counts-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def tfidf_pipeline(text_col: str) -> Pipeline:
    """Unit-length TF-IDF vectors (the default text encoder)."""
    return Pipeline(stages=_features(text_col) + [Normalizer(inputCol="features", outputCol="vector", p=2.0)])


def fit_relevance(training: DataFrame, text_col: str, label_col: str = "label",
                  path: str | None = None) -> PipelineModel:
    """The model from texts to probabilities; ``training`` may hold ``term_counts`` instead of texts."""
    label = F.col(label_col).cast("double").alias(label_col)
    if "_tf" in training.columns:
        counts = training.select("_tf", label)
    else:
        counts = term_counts(training.select(text_col, label), text_col)
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=50, regParam=0.01)
    fitted = Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"), lr]).fit(counts)
    model = PipelineModel(_terms(text_col) + fitted.stages)
    if path:
        model.write().overwrite().save(path)
    return model


def score_relevance(model: PipelineModel, docs: DataFrame, id_col: str) -> DataFrame:
    """(id, p_yes): probability of the positive class; ``docs`` may hold ``term_counts`` instead of texts."""
    if "_tf" in docs.columns:
        model = PipelineModel([s for s in model.stages if not isinstance(s, (RegexTokenizer, StopWordsRemover, HashingTF))])
    out = model.transform(docs)
    return out.select(id_col, vector_to_array("probability")[1].alias("p_yes"))


_ENCODERS: dict[str, Callable] = {}      # lives as long as the Python worker


def encode_with(docs: DataFrame, id_col: str, text_col: str, name: str,
                factory: "Callable[[], Callable[[list[str]], list[list[float]]]]") -> DataFrame:
    """Pluggable encoder for an external embedding model, applied per Arrow batch with mapInPandas.
    ``factory`` makes the encoder (it loads the model) once in each Python worker, where it is kept
    under ``name`` for later tasks; only the factory travels with the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _ENCODERS:
            _ENCODERS[name] = factory()
        for b in batches:
            vecs = _ENCODERS[name](b[text_col].fillna("").tolist())
            yield pd.DataFrame({id_col: b[id_col], "embedding": [list(map(float, v)) for v in vecs]})
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, embedding array<double>"
    return docs.select(id_col, text_col).mapInPandas(run, schema)
