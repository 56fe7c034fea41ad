"""Rows with every odd case, and tiny corpora for the brute-force checks."""

import random

from pyspark.sql import types as T

#: Columns beside those of ``documents``, named like what operators make.
EXTRA = ["fp", "component_id", "n_words", "kept", "ids", "id", "th", "tag", "spans", "shard", "fail_bits", "__quality", "__coded", "__secrets", "__text_hash"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_rows():
    rng = random.Random(4)
    long = " ".join(words(rng, 60_000))
    plain = "the quick brown fox jumps over the lazy dog and then it runs back to the den in the green hills far away from here"
    texts = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "é"), (5, plain), (5, plain), (6, plain), (None, plain), (None, None), (7, long), (8, long + " end"), (9, "\x00\x7f 日本 🙂"), (10, plain.upper()), (10, "another text of the same id " + plain)]
    return [(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in texts]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
