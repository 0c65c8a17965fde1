"""Edge rows that every operator must take: nulls, empty and very long texts, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, node bigint, kept boolean, sig string"
PROSE = ("the river runs past the old mill where children used to gather on warm evenings and listen to stories "
         "told by the miller about distant towns and the people who lived there long before the railway came")


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows with the other columns of documents and some with clashing names."""
    return spark.createDataFrame([(i, t, None, "src", None if t is None else len(t), 1, 2, None, "x") for i, t in rows], DOCS)


def edge_rows() -> list[tuple]:
    long = " ".join(f"word{i * 7919 % 30011}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE), (6, long), (7, "x" * 100_000),
            (8, "ab " * 20_000), (None, None), (9, "one")]
