"""A: sources and sinks."""

from pyspark.sql import functions as F

from tabwright.functions.numbers import clean_numeric
from tabwright.session import fresh_path
from tabwright.sources.tables import before_after, choose_dataset, preview, read_table_csv, write_csv
from tabwright.operators.impute import impute_mean

from . import query
from .views import cte, table, view


@query(
    "A1_read_table_csv",
    cte("dirty_orders")
    + """SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN price_txt = 'n/a' THEN NULL ELSE price_txt END AS price_txt,
    price_num, prio_txt FROM dirty_orders""",
)
def _a1(spark, sf):
    path = fresh_path(spark, "csv")
    write_csv(view(spark, sf, "dirty_orders"), path)
    return read_table_csv(spark, path)


@query(
    "A2_write_csv",
    """SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def _a2(spark, sf):
    path = fresh_path(spark, "csv")
    write_csv(table(spark, sf, "customer"), path)
    schema = "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string"
    return read_table_csv(spark, path, schema)


@query("A3_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _a3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_down"))
    return preview(orders, 10, ["_down", "o_orderkey"]).drop("_down")


@query(
    "A4_before_after",
    cte("dirty_part")
    + """SELECT size_txt AS original, regexp_replace(size_txt, '[^0-9.-]', '', 'g')::DOUBLE AS cleaned
    FROM dirty_part ORDER BY size_txt, p_partkey LIMIT 10""",
)
def _a4(spark, sf):
    parts = view(spark, sf, "dirty_part")
    return before_after(parts, "size_txt", clean_numeric(F.col("size_txt"), "remove_units"), ["size_txt", "p_partkey"])


@query(
    "A5_choose_dataset",
    cte("dirty_orders")
    + """SELECT use_cleaned, count(*)::BIGINT AS n, round(avg(v), 4) AS mean FROM (
      SELECT false AS use_cleaned, price_num AS v FROM dirty_orders UNION ALL
      SELECT true, coalesce(price_num, (SELECT avg(price_num) FROM dirty_orders)) FROM dirty_orders)
    WHERE v IS NOT NULL GROUP BY use_cleaned""",
)
def _a5(spark, sf):
    original = view(spark, sf, "dirty_orders")
    cleaned = impute_mean(original, ["price_num"])

    def facts(use):
        chosen = choose_dataset(original, cleaned, use).where("price_num is not null")
        return chosen.agg(F.count("*").alias("n"), F.round(F.avg("price_num"), 4).alias("mean")).withColumn("use_cleaned", F.lit(use))

    return facts(False).unionByName(facts(True))
