"""Small tables with the awkward cases that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, shard string, spans string"


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, empty, blank, very long and repeated texts, a repeated row, and extra columns with clashing names."""
    texts = [None, "", " \n\t ", LONG, "same words here again and again " * 12, "same words here again and again " * 12, "x", "ÀÉ ñandú 日本語 \x01 \x02", "a" * 70_000, "b\n" * 3000]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s1", None, "s0"][i % 3], 1, "h", "z", None, "q") for i, t in enumerate(texts)]
    rows += [(4, texts[4], "fr", None, 1, "h", "z", None, "q")] * 2 + [(None, "no id at all", "en", "s0", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark: SparkSession, schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame([], schema)


def labels(spark: SparkSession, rows=((4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1))) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
