import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text[, lang, source])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None, None, None), (None, "alpha beta"), (3, ""), (4, "   "), (5, "word " * 30_000, None, "big"), (6, "alpha beta gamma delta", "de", None)]
    docs = make_docs(rows)
    return docs.select("*", F.lit("x").alias("TEXT_"), F.lit(1).alias("rank"), F.lit(2).alias("copy"), F.lit("y").alias("_key"), F.lit(0).alias("bin_id"), F.lit("z").alias("language"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
