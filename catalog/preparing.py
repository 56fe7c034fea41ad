"""K: model preparation over the order totals and the dirty orders."""

from pyspark.sql import functions as F

from tabwright.operators.prep import (
    augment_summary, binarize_by_median, bootstrap_augment, drop_duplicate_rows, drop_weak_features, interaction_features,
    outlier_counts, polynomial_features, prepare_xy, quality_metrics, recommend_model, remove_outliers, standard_scale,
    stratified_augment, train_test_split,
)

from . import query
from .describing import rounded
from .views import cte, hash_sql, table, view

LINES = cte("order_lines")
FEATURES = ["n_lines", "quantity", "discount"]


def order_sql(key: str) -> str:
    """Hash order of a key."""
    return f"md5(concat(cast({key} AS varchar), '|42')), {key}"


def split_sql(source: str, key: str, name: str = "s") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (ORDER BY {order_sql(key)}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM {source})"""


@query(
    "K1_prepare_xy",
    cte("dirty_orders")
    + """, codes AS (SELECT prio_txt, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM dirty_orders WHERE prio_txt IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, price_num, coalesce(code, -1)::DOUBLE AS label FROM dirty_orders LEFT JOIN codes USING (prio_txt)""",
)
def _k1(spark, sf):
    return prepare_xy(view(spark, sf, "dirty_orders"), "prio_txt", ["price_num", "price_txt"], ["o_orderkey"]).df


@query(
    "K1_prepare_xy_text_features",
    """WITH a AS (SELECT o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS a FROM orders GROUP BY 1),
    b AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS b FROM orders GROUP BY 1)
    SELECT o_orderkey, a::DOUBLE AS o_orderstatus, b::DOUBLE AS o_orderpriority, o_totalprice AS label
    FROM orders JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority)""",
)
def _k1_text(spark, sf):
    return prepare_xy(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]).df


@query("K2_train_test_split", f"WITH {split_sql('orders', 'o_orderkey')} SELECT o_orderkey, is_test FROM s")
def _k2(spark, sf):
    train, test = train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query(
    "K3_standard_scale",
    LINES
    + f", {split_sql('order_lines', 'l_orderkey')} SELECT l_orderkey, is_test, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM s WHERE NOT is_test)) / (SELECT stddev_pop({c}) FROM s WHERE NOT is_test), 8) AS {c}" for c in FEATURES
    )
    + " FROM s",
)
def _k3(spark, sf):
    train, test = train_test_split(view(spark, sf, "order_lines").select("l_orderkey", *FEATURES), "l_orderkey")
    train, test = standard_scale(train, test, FEATURES)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return rounded(both, 8, *FEATURES)


@query(
    "K4_binarize_by_median",
    "SELECT o_orderkey, (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT::DOUBLE AS label FROM orders",
)
def _k4(spark, sf):
    return binarize_by_median(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "label")


@query(
    "K5_recommend_model",
    LINES
    + f""", {split_sql('order_lines', 'l_orderkey')}, f AS (SELECT count(*) AS n,
      (abs(corr(n_lines, label)) + abs(corr(quantity, label)) + abs(corr(discount, label))) / 3 AS r FROM s WHERE NOT is_test)
    SELECT 'size' AS topic, CASE WHEN n < 100 THEN 'Small dataset: Linear, Ridge, Lasso' WHEN n < 1000 THEN 'Medium dataset: Random Forest, Gradient Boosting'
      ELSE 'Large dataset: any model, Gradient Boosting and Random Forest excel' END AS advice FROM f
    UNION ALL SELECT 'linearity', CASE WHEN r > 0.7 THEN 'Strong linear relationship: Linear Regression'
      WHEN r > 0.3 THEN 'Moderate relationship: Random Forest, Gradient Boosting' ELSE 'Weak linear relationship: SVM, Neural Network' END FROM f""",
)
def _k5(spark, sf):
    train, _ = train_test_split(view(spark, sf, "order_lines"), "l_orderkey")
    return recommend_model(train, FEATURES, "label", "Regression")


@query(
    "K6_polynomial_features",
    LINES
    + """SELECT l_orderkey, quantity, quantity * quantity AS quantity_squared, quantity * quantity * quantity AS quantity_cubed FROM order_lines""",
)
def _k6(spark, sf):
    return polynomial_features(view(spark, sf, "order_lines").select("l_orderkey", "quantity"), ["quantity"])


@query(
    "K7_interaction_features",
    LINES
    + """SELECT l_orderkey, n_lines, quantity, round(discount, 10) AS discount, n_lines * quantity AS n_lines_x_quantity,
      round(n_lines * discount, 8) AS n_lines_x_discount, round(quantity * discount, 8) AS quantity_x_discount FROM order_lines""",
)
def _k7(spark, sf):
    made = interaction_features(view(spark, sf, "order_lines").select("l_orderkey", *FEATURES), FEATURES)
    return rounded(rounded(made, 10, "discount"), 8, "n_lines_x_discount", "quantity_x_discount")


@query(
    "K8_drop_weak_features",
    LINES + "SELECT l_orderkey, n_lines, quantity, round(label, 2) AS label FROM order_lines",
)
def _k8(spark, sf):
    rows = view(spark, sf, "order_lines").select("l_orderkey", *FEATURES, F.round("label", 2).alias("label"))
    return drop_weak_features(rows, FEATURES, "label")


Z = """abs({x} - (SELECT avg({x}) FROM outlier_orders)) / (SELECT stddev_pop({x}) FROM outlier_orders)"""
ZC = """abs(coalesce(c, (SELECT avg(c) FROM outlier_orders)) - (SELECT avg(c) FROM outlier_orders))
  / (SELECT stddev_pop(coalesce(c, (SELECT avg(c) FROM outlier_orders))) FROM outlier_orders)"""


@query(
    "K9_outlier_counts",
    cte("outlier_orders")
    + f"""SELECT * FROM (SELECT 'x' AS "column", count(*) FILTER (WHERE {Z.format(x='x')} > 3)::BIGINT AS outliers,
      round(count(*) FILTER (WHERE {Z.format(x='x')} > 3) / count(*) * 100, 2) AS pct FROM outlier_orders
      UNION ALL SELECT 'c', count(*) FILTER (WHERE {ZC} > 3), round(count(*) FILTER (WHERE {ZC} > 3) / count(*) * 100, 2) FROM outlier_orders) WHERE outliers > 0""",
)
def _k9(spark, sf):
    return outlier_counts(view(spark, sf, "outlier_orders"), ["x", "c", "k"])


@query(
    "K10_remove_outliers",
    cte("outlier_orders") + f"SELECT * FROM outlier_orders WHERE {Z.format(x='x')} < 3 AND {ZC} < 3",
)
def _k10(spark, sf):
    return remove_outliers(view(spark, sf, "outlier_orders"), ["x", "c", "k"])


@query(
    "K11_drop_duplicate_rows",
    cte("dup_lineitem") + """SELECT l_returnflag, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM (SELECT DISTINCT * FROM dup_lineitem) GROUP BY 1""",
)
def _k11(spark, sf):
    rows = drop_duplicate_rows(view(spark, sf, "dup_lineitem"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "K12_quality_metrics",
    cte("dirty_orders")
    + """SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT price_num, prio_txt FROM dirty_orders)))::BIGINT AS duplicates,
      (2 * count(*) - count(price_num) - count(prio_txt))::BIGINT AS missing, 2::BIGINT AS features, count(*)::BIGINT AS samples FROM dirty_orders""",
)
def _k12(spark, sf):
    return quality_metrics(view(spark, sf, "dirty_orders"), ["price_num", "prio_txt"])


def resample_sql(source: str, key: str, by: str | None, multiplier: int) -> str:
    """CTEs ending in ``drawn``: the drawn rows with ``copy`` and ``draw``."""
    group = f"PARTITION BY {by} " if by else ""
    same = f"AND p.g IS NOT DISTINCT FROM n.{by}" if by else ""
    g = by or "0"
    draw = hash_sql(f"concat(cast({key} AS varchar), '#', cast(copy AS varchar))")
    return f"""numbered AS (SELECT *, row_number() OVER ({group}ORDER BY {order_sql(key)}) - 1 AS row_, count(*) OVER ({group}) AS rows_ FROM {source}),
    picks AS (SELECT {g} AS g, copy, floor({draw} / 4503599627370496.0::DOUBLE * rows_) AS pick FROM numbered, range(1, {multiplier}) c(copy)),
    drawn AS (SELECT n.* EXCLUDE (row_, rows_), copy::INT AS copy, (row_number() OVER (PARTITION BY copy, {key}) - 1)::INT AS draw
      FROM picks p JOIN numbered n ON p.pick = n.row_ {same})"""


@query(
    "K13_bootstrap_augment",
    f"WITH {resample_sql('orders', 'o_orderkey', None, 3)} SELECT o_orderkey, o_totalprice, 0 AS copy, 0 AS draw FROM orders UNION ALL SELECT o_orderkey, o_totalprice, copy, draw FROM drawn",
)
def _k13(spark, sf):
    return bootstrap_augment(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3)


@query(
    "K14_stratified_augment",
    f"WITH {resample_sql('orders', 'o_orderkey', 'o_orderpriority', 2)} SELECT o_orderkey, o_orderpriority, 0 AS copy, 0 AS draw FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, copy, draw FROM drawn",
)
def _k14(spark, sf):
    return stratified_augment(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 2)


@query(
    "K15_augment_summary",
    "SELECT count(*)::BIGINT AS original_size, (count(*) * 3)::BIGINT AS new_size, 3.0::DOUBLE AS factor FROM orders",
)
def _k15(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return augment_summary(orders, bootstrap_augment(orders, "o_orderkey", 3))
