"""The corpus pipeline: quality rules, near-duplicates, test leaks, secrets, tokens.

Each stage reads what its predecessor kept, as Parquet, and works on all of it. All stages but the last return the columns of
``documents``. The last one has, per document that is left, its number of tokens and the digests of ids and of decoded bytes.

No SQL states the rows of :func:`run`: component search, alignment and tokenizer are beyond it. The tests hold them against
a brute-force version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import byte_bpe, decontamination, quality_rules, secret_scan, simhash
from tabwright.llm.common import table
from tabwright.session import drop_path, fresh_path

RANKS = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` follows the text."""
    out = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids, and the ids are decoded again."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.drop("text")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has read is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := fresh_path(spark, f"stage{k}"))
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
