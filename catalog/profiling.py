"""E: data-quality profile."""

from pyspark.sql import functions as F

from tabwright.functions.numbers import clean_numeric
from tabwright.operators.quality import (
    conversion_loss, duplicate_count, missing_report, missing_totals, non_numeric_report, special_char_report,
    suggest_cleaning, table_summary, text_issue_report,
)

from . import query
from .typing_ import number_sql
from .views import cte, table, view

SPECIAL_MATCH = r"regexp_matches({c}, '[^\p{{L}}\p{{N}}_\s]')"
NUMERIC_FIXES = "extract_numbers,remove_currency,remove_percentage,remove_units,remove_commas,trim_whitespace,smart_convert"
TEXT_FIXES = "remove_special_chars,trim_whitespace,standardize,remove_duplicates_spaces,lowercase,remove_numbers"


@query(
    "E1_table_summary",
    """SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS n_columns,
      (count(*) * 32 + sum(strlen(o_orderstatus) + strlen(o_orderpriority)))::BIGINT AS bytes,
      (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::BIGINT AS duplicate_rows FROM orders""",
)
def _e1(spark, sf):
    return table_summary(table(spark, sf, "orders"))


@query(
    "E2_duplicate_count",
    cte("dup_lineitem")
    + """SELECT ((SELECT count(*) FROM dup_lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_lineitem)))::BIGINT AS duplicate_rows""",
)
def _e2(spark, sf):
    return duplicate_count(view(spark, sf, "dup_lineitem"))


@query(
    "E3_missing_report",
    cte("dirty_orders")
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (count(*) - count({c}))::BIGINT AS missing,
        round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, '{t}' AS dtype FROM dirty_orders"""
        for c, t in [("o_orderkey", "bigint"), ("price_txt", "string"), ("price_num", "double"), ("prio_txt", "string")]
    )
    + ") WHERE missing > 0",
)
def _e3(spark, sf):
    return missing_report(view(spark, sf, "dirty_orders"))


@query(
    "E4_missing_totals",
    cte("dirty_orders")
    + """SELECT (count(*) - count(price_num) + count(*) - count(o_orderkey))::BIGINT AS numeric_missing,
      (2 * count(*) - count(price_txt) - count(prio_txt))::BIGINT AS string_missing,
      (4 * count(*) - count(price_txt) - count(prio_txt) - count(price_num) - count(o_orderkey))::BIGINT AS all_missing FROM dirty_orders""",
)
def _e4(spark, sf):
    return missing_totals(view(spark, sf, "dirty_orders"))


def _joined(report):
    return report.withColumn("examples", F.array_join("examples", "|"))


@query(
    "E5_non_numeric_report",
    cte("mixed_orders")
    + f"""SELECT 'price_txt' AS "column", count(*)::BIGINT AS issues, round(count(*) / (SELECT count(*) FROM mixed_orders) * 100, 2) AS pct,
      (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT price_txt AS v FROM mixed_orders
        WHERE price_txt IS NOT NULL AND {number_sql('price_txt')} IS NULL ORDER BY v LIMIT 10)) AS examples
    FROM mixed_orders WHERE price_txt IS NOT NULL AND {number_sql('price_txt')} IS NULL""",
)
def _e5(spark, sf):
    return _joined(non_numeric_report(view(spark, sf, "mixed_orders")))


def _special_sql(source: str, c: str) -> str:
    bad = SPECIAL_MATCH.format(c=c)
    return f"""SELECT '{c}' AS "column", count(*)::BIGINT AS issues, round(count(*) / (SELECT count(*) FROM {source}) * 100, 2) AS pct,
      (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {bad} ORDER BY v LIMIT 10)) AS examples
    FROM {source} WHERE {bad}"""


@query(
    "E6_special_char_report",
    cte("mixed_orders") + _special_sql("mixed_orders", "status_txt") + " UNION ALL " + _special_sql("mixed_orders", "o_orderpriority"),
)
def _e6(spark, sf):
    return _joined(special_char_report(view(spark, sf, "mixed_orders")))


@query("E6_special_char_report_long_text", _special_sql("documents", "text"))
def _e6_long(spark, sf):
    texts = table(spark, sf, "documents").select("text")
    return _joined(special_char_report(texts, {"text": "text"}))


@query(
    "E7_conversion_loss",
    cte("mixed_orders")
    + f"""SELECT (count(price_txt) - count({number_sql("replace(price_txt, ',', '')")}))::BIGINT AS lost FROM mixed_orders""",
)
def _e7(spark, sf):
    return conversion_loss(view(spark, sf, "mixed_orders"), "price_txt", clean_numeric(F.col("price_txt"), "remove_commas"))


@query(
    "E8_text_issue_report",
    cte("dirty_orders")
    + r""", v AS (SELECT DISTINCT prio_txt AS v FROM dirty_orders WHERE prio_txt IS NOT NULL),
    f AS (SELECT bool_or(regexp_matches(v, '[A-Z]')) AND bool_or(regexp_matches(v, '[a-z]')) AS a, bool_or(v <> trim(v)) AS b,
      bool_or(regexp_matches(v, ' {2,}')) AS c, bool_or(regexp_matches(v, '[^\p{L}\p{N}_\s]')) AS d,
      count(*) > 3 AND count(DISTINCT trim(lower(v))) < count(*) AS e, count(*) > 50 AS skip FROM v)
    SELECT issue, CASE WHEN skip THEN 'skipped' WHEN hit THEN 'found' ELSE 'absent' END AS status, methods FROM (
      SELECT 'Mixed case values' AS issue, a AS hit, skip, 'lowercase,standardize' AS methods FROM f
      UNION ALL SELECT 'Leading/trailing whitespace', b, skip, 'trim_whitespace' FROM f
      UNION ALL SELECT 'Multiple consecutive spaces', c, skip, 'remove_duplicates_spaces' FROM f
      UNION ALL SELECT 'Special characters in values', d, skip, 'remove_special_chars' FROM f
      UNION ALL SELECT 'Potential duplicates (different cases/spaces)', e, skip, 'standardize' FROM f)""",
)
def _e8(spark, sf):
    return text_issue_report(view(spark, sf, "dirty_orders"), "prio_txt").withColumn("methods", F.array_join("methods", ","))


@query(
    "E9_suggest_cleaning",
    cte("mixed_orders")
    + f"""SELECT 'price_txt' AS "column", 'non-numeric' AS issue, count(*)::BIGINT AS issues, '{NUMERIC_FIXES}' AS methods
      FROM mixed_orders WHERE price_txt IS NOT NULL AND {number_sql('price_txt')} IS NULL
    UNION ALL SELECT 'status_txt', 'special-chars', count(*)::BIGINT, '{TEXT_FIXES}' FROM mixed_orders WHERE {SPECIAL_MATCH.format(c='status_txt')}
    UNION ALL SELECT 'o_orderpriority', 'special-chars', count(*)::BIGINT, '{TEXT_FIXES}' FROM mixed_orders WHERE {SPECIAL_MATCH.format(c='o_orderpriority')}""",
)
def _e9(spark, sf):
    return suggest_cleaning(view(spark, sf, "mixed_orders")).withColumn("methods", F.array_join("methods", ","))
