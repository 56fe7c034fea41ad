"""C and D: numeric and text cleaning of every row of a dirty view."""

from pyspark.sql import functions as F

from tabwright.functions.numbers import clean_numeric
from tabwright.functions.text import MISSING_MARKERS, clean_text, markers_to_null

from . import query
from .typing_ import number_sql
from .views import cte, table, view

KEEP_DIGITS = "regexp_replace({c}, '[^0-9.-]', '', 'g')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _numeric(name, method, source, key, column, expression):
    @query(name, cte(source) + f"SELECT {key}, {column} AS original, {expression} AS cleaned FROM {source}")
    def run(spark, sf):
        return view(spark, sf, source).select(
            key, F.col(column).alias("original"), clean_numeric(F.col(column), method).alias("cleaned")
        )


_digits = number_sql(KEEP_DIGITS.format(c="price_txt"))
_numeric("C1_extract_numbers", "extract_numbers", "dirty_orders", "o_orderkey", "price_txt", _digits)
_numeric(
    "C2_remove_currency", "remove_currency", "dirty_orders", "o_orderkey", "price_txt",
    number_sql("regexp_replace(price_txt, '[$€¥₹₽,]', '', 'g')"),
)
_numeric(
    "C3_remove_percentage", "remove_percentage", "dirty_part", "p_partkey", "pct_txt",
    f"({number_sql("replace(pct_txt, '%', '')")}) / 100",
)
_numeric(
    "C4_remove_units", "remove_units", "dirty_part", "p_partkey", "size_txt", number_sql(KEEP_DIGITS.format(c="size_txt"))
)
_numeric(
    "C5_remove_commas", "remove_commas", "dirty_part", "p_partkey", "thousands_txt", number_sql("replace(thousands_txt, ',', '')")
)
_numeric("C6_trim_whitespace", "trim_whitespace", "dirty_part", "p_partkey", "padded_txt", number_sql(strip_sql("padded_txt")))
_numeric("C7_smart_convert", "smart_convert", "dirty_orders", "o_orderkey", "price_txt", _digits)

SPECIAL = r"""'[!@#$%^&*()_+=\[\]{};:''".,<>?/\\|`~-]'"""
NON_WORD = r"'[^\p{L}\p{N}_\s]'"


def standard_sql(c: str) -> str:
    return f"lower(regexp_replace({strip_sql(c)}, ' +', ' ', 'g'))"


TEXT_SQL = {
    "D1_remove_special_chars": ("remove_special_chars", lambda c: strip_sql(f"regexp_replace({c}, {SPECIAL}, '', 'g')")),
    "D2_trim_whitespace": ("trim_whitespace", strip_sql),
    "D3_lowercase": ("lowercase", lambda c: strip_sql(f"lower({c})")),
    "D4_remove_duplicates_spaces": ("remove_duplicates_spaces", lambda c: strip_sql(f"regexp_replace({c}, ' +', ' ', 'g')")),
    "D5_standardize": ("standardize", standard_sql),
    "D6_remove_numbers": ("remove_numbers", lambda c: strip_sql(f"regexp_replace({c}, '[0-9]', '', 'g')")),
    "D7_remove_non_word": ("remove_non_word", lambda c: strip_sql(f"regexp_replace({c}, {NON_WORD}, '', 'g')")),
    "D8_standardize_strict": ("standardize_strict", lambda c: f"regexp_replace({standard_sql(c)}, {NON_WORD}, '', 'g')"),
    "D10_keep_marker": ("keep_marker", lambda c: c),
}


def _text(name, method, sql):
    body = f"""SELECT 'part' AS source, p_partkey AS id, {sql('name_txt')} AS cleaned FROM dirty_part
    UNION ALL SELECT 'orders', o_orderkey, {sql('prio_txt')} FROM dirty_orders
    UNION ALL SELECT 'documents', doc_id, md5({sql('text')}) FROM documents"""

    @query(name, cte("dirty_part", "dirty_orders") + body)
    def run(spark, sf):
        parts = view(spark, sf, "dirty_part").select(
            F.lit("part").alias("source"), F.col("p_partkey").alias("id"), clean_text(F.col("name_txt"), method).alias("cleaned")
        )
        orders = view(spark, sf, "dirty_orders").select(F.lit("orders"), "o_orderkey", clean_text(F.col("prio_txt"), method))
        texts = table(spark, sf, "documents").select(F.lit("documents"), "doc_id", F.md5(clean_text(F.col("text"), method)))
        return parts.union(orders).union(texts)


for _name, (_method, _sql) in TEXT_SQL.items():
    _text(_name, _method, _sql)

MARKERS = ", ".join(f"'{m}'" for m in MISSING_MARKERS)


@query(
    "D9_markers_to_null",
    cte("dirty_part")
    + f"SELECT p_partkey, CASE WHEN lower({strip_sql('marker_txt')}) NOT IN ({MARKERS}) THEN marker_txt END AS cleaned FROM dirty_part",
)
def _d9(spark, sf):
    return view(spark, sf, "dirty_part").select("p_partkey", markers_to_null(F.col("marker_txt")).alias("cleaned"))


def _without_markers(c: str) -> str:
    for marker in MISSING_MARKERS:
        escaped = "".join("\\" + ch if ch in ".?-/" else ch for ch in marker)
        c = f"regexp_replace({c}, '{escaped}', '', 'gi')"
    return c


@query(
    "D9_markers_to_null_substring",
    cte("dirty_part")
    + f"""SELECT p_partkey, CASE WHEN {strip_sql('c')} <> '' THEN c END AS cleaned
    FROM (SELECT p_partkey, {_without_markers('marker_txt')} AS c FROM dirty_part)""",
)
def _d9_substring(spark, sf):
    return view(spark, sf, "dirty_part").select("p_partkey", markers_to_null(F.col("marker_txt"), True).alias("cleaned"))
