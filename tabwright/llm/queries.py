"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from tabwright.llm import byte_bpe, decontamination, html_text, lexical_search, license_scan, minhash, quality_rules, secret_scan, sharding, simhash, spelling, sql, substring_dedup, warc
from tabwright.llm.common import table
from tabwright.llm.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op6_quality_rules", sql.OP6)
def op6(spark, sf_dir):
    return quality_rules.assess(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_license_scan", sql.OP2)
def op2(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup", sql.OP9)
def op9(spark, sf_dir):
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_sharding")
def op5(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op8_warc_derivatives")
def op8(spark, sf_dir):
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query("op13_lexical_search", sql.OP13)
def op13(spark, sf_dir):
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op11_minhash", sql.OP11)
def op11(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
