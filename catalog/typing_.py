"""B: column kinds and coercion."""

from pyspark.sql import functions as F

from tabwright.functions.numbers import to_numeric
from tabwright.operators.coltypes import (
    coerce_all_numeric, default_target, detect_feature_types, dtype_report, factorize, numeric_columns, string_columns,
    suggest_problem_type, to_timestamp_rate,
)

from . import query
from .views import cte, table, view

NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def number_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


MIXED = ["o_orderkey", "o_custkey", "price_txt", "status_txt", "date_txt", "o_orderpriority"]


@query(
    "B1_detect_feature_types",
    cte("mixed_orders")
    + ", cells AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", cast({c} AS varchar) AS v FROM mixed_orders" for c in MIXED)
    + f"""), facts AS (
      SELECT "column", count(*) AS n, count({number_sql('v')}) AS n_numeric, count(DISTINCT v) AS n_unique,
        count(DISTINCT {number_sql('v')}) AS k, min({number_sql('v')}) AS low, max({number_sql('v')}) AS high,
        bool_and({number_sql('v')} = floor({number_sql('v')})) AS whole, count(TRY_CAST(v AS DATE)) AS n_date
      FROM cells WHERE v IS NOT NULL GROUP BY "column")
    SELECT "column", n::BIGINT AS n, n_numeric::BIGINT AS n_numeric, n_unique::BIGINT AS n_unique, round(n_unique / n, 6) AS unique_ratio,
      CASE WHEN n_numeric / n > 0.9 THEN
          CASE WHEN n_unique > 30 THEN 'numeric'
               WHEN whole AND ((low = 0 AND high = k - 1) OR (low = 1 AND high = k)) THEN 'categorical'
               WHEN n_unique <= 20 THEN 'categorical' ELSE 'numeric' END
        WHEN n_date / n > 0.8 THEN 'date' WHEN n_unique <= 20 OR n_unique / n < 0.5 THEN 'categorical' ELSE 'text' END AS feature_type
    FROM facts""",
)
def _b1(spark, sf):
    return detect_feature_types(view(spark, sf, "mixed_orders")).withColumn("unique_ratio", F.round("unique_ratio", 6))


@query(
    "B1_detect_feature_types_documents",
    """SELECT 'lang' AS "column", 'categorical' AS feature_type, count(DISTINCT lang)::BIGINT AS n_unique FROM documents
    UNION ALL SELECT 'text', CASE WHEN count(DISTINCT text) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END, count(DISTINCT text)::BIGINT FROM documents""",
)
def _b1_documents(spark, sf):
    kinds = detect_feature_types(table(spark, sf, "documents").select("lang", "text"))
    return kinds.select("column", "feature_type", "n_unique")


@query(
    "B2_to_numeric",
    cte("mixed_orders") + f"SELECT o_orderkey, {number_sql('price_txt')} AS price FROM mixed_orders",
)
def _b2(spark, sf):
    return view(spark, sf, "mixed_orders").select("o_orderkey", to_numeric(F.col("price_txt")).alias("price"))


@query(
    "B3_to_timestamp_rate",
    cte("mixed_orders")
    + """SELECT count(date_txt)::BIGINT AS n, 'yyyy-MM-dd' AS format,
    round(count(try_strptime(date_txt, '%Y-%m-%d')) / count(date_txt), 6) AS rate FROM mixed_orders""",
)
def _b3(spark, sf):
    return to_timestamp_rate(view(spark, sf, "mixed_orders"), "date_txt").withColumn("rate", F.round("rate", 6))


@query(
    "B4_columns_by_type",
    """SELECT 'numeric' AS kind, count(o_orderkey) + count(o_custkey) + count(o_totalprice) AS cells FROM orders
    UNION ALL SELECT 'string', count(o_orderstatus) + count(o_orderpriority) FROM orders""",
)
def _b4(spark, sf):
    orders = table(spark, sf, "orders")

    def cells(kind, names):
        return orders.agg(sum([F.count(c) for c in names], F.lit(0)).alias("cells")).withColumn("kind", F.lit(kind))

    return cells("numeric", numeric_columns(orders)).unionByName(cells("string", string_columns(orders)))


@query(
    "B5_coerce_all_numeric",
    cte("mixed_orders")
    + f"""SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, {number_sql('price_txt')} AS price_txt,
    NULL::DOUBLE AS status_txt, NULL::DOUBLE AS date_txt, NULL::DOUBLE AS o_orderpriority FROM mixed_orders""",
)
def _b5(spark, sf):
    return coerce_all_numeric(view(spark, sf, "mixed_orders"))


@query(
    "B6_factorize",
    cte("dirty_orders")
    + """, first AS (SELECT prio_txt, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM dirty_orders
      WHERE prio_txt IS NOT NULL GROUP BY prio_txt)
    SELECT o_orderkey, prio_txt, coalesce(code, -1)::BIGINT AS code FROM dirty_orders LEFT JOIN first USING (prio_txt)""",
)
def _b6(spark, sf):
    return factorize(view(spark, sf, "dirty_orders").select("o_orderkey", "prio_txt"), "prio_txt", ["o_orderkey"])


@query("B7_default_target", "SELECT 'o_orderkey' AS target, count(DISTINCT o_orderkey)::BIGINT AS levels FROM orders")
def _b7(spark, sf):
    orders = table(spark, sf, "orders")
    target = default_target(orders.columns)
    return orders.agg(F.count_distinct(target).alias("levels")).withColumn("target", F.lit(target))


@query(
    "B8_suggest_problem_type",
    """SELECT 'o_orderpriority' AS target, count(DISTINCT o_orderpriority)::BIGINT AS n_unique, 'Classification' AS problem_type FROM orders
    UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice)::BIGINT,
      CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'Classification' ELSE 'Regression' END FROM orders""",
)
def _b8(spark, sf):
    orders = table(spark, sf, "orders")
    return suggest_problem_type(orders, "o_orderpriority").unionByName(suggest_problem_type(orders, "o_totalprice"))


@query(
    "B9_dtype_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c})::BIGINT AS non_null, count(DISTINCT {c})::BIGINT AS n_unique FROM lineitem"
        for c, t in [
            ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
            ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
            ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
        ]
    ),
)
def _b9(spark, sf):
    return dtype_report(table(spark, sf, "lineitem"))
