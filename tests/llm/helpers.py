"""Shared fixtures: the awkward rows that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [None, "", "   \n\t ", "!!! ???", "one", "One two THREE", "Ünïcödé wörds ünd ßtraße 日本語 🙂", LONG,
           "same text here for everyone to see", "same text here for everyone to see", "a" * 5_000]


def rows(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts, extra=()):
    return spark.createDataFrame(rows(texts) + list(extra), DOCS)


def awkward(spark):
    """NULLs in every column, repeated rows, long and empty texts, and extra columns with names used inside."""
    from pyspark.sql import functions as F

    extra = [(None, "a row without an id", None, None, None), (None, None, None, None, None),
             (3, "!!! ???", "en", "s", 7), (5, "another text under a used id", "en", "s", 28)]
    df = frame(spark, AWKWARD, extra)
    for name in ("key", "dk", "scanned", "score", "hits", "benchmark", "language", "fp", "m", "Asked", "null", "shard"):
        df = df.withColumn(name, F.lit("x"))
    return df


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())
