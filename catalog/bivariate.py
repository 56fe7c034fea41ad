"""I and J: two-variable analyses and clustering."""

from pyspark.sql import functions as F

from tabwright.operators.bivariate import (
    anova_oneway, correlation_matrix, regression_line, scatter_sample, simple_regression,
)
from tabwright.operators.cluster import kmeans, kmeans_summary, scaled_inputs

from . import query
from .describing import rounded
from .views import cte, hash_sql, table, view

PAIR = "l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL"


@query(
    "I1_simple_regression",
    f"""SELECT count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
      round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
      printf('Y = %.4f + %.4f*X', regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)) AS equation
    FROM lineitem WHERE {PAIR}""",
)
def _i1(spark, sf):
    fit = simple_regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(fit, 4, "slope", "intercept"), 8, "r2")


@query(
    "I2_regression_line",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE {PAIR})
    SELECT i::BIGINT AS point, round(low + i * (high - low) / 99, 6) AS x, round(a + b * (low + i * (high - low) / 99), 4) AS y FROM range(100) r(i), f""",
)
def _i2(spark, sf):
    return rounded(rounded(regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 6, "x"), 4, "y")


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "I3_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in CORRELATED for b in CORRELATED
    ),
)
def _i3(spark, sf):
    return rounded(correlation_matrix(table(spark, sf, "lineitem").select(*CORRELATED)), 8, "r")


@query(
    "I3_correlation_matrix_with_gaps",
    cte("outlier_orders")
    + """SELECT 'x' AS a, 'x' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'c', 'c', 1.0::DOUBLE UNION ALL SELECT 'k', 'k', NULL
    UNION ALL SELECT 'x', 'k', NULL UNION ALL SELECT 'k', 'x', NULL UNION ALL SELECT 'c', 'k', NULL UNION ALL SELECT 'k', 'c', NULL
    UNION ALL SELECT a, b, round(r, 8) FROM (SELECT corr(x, c) AS r FROM outlier_orders), (VALUES ('x', 'c'), ('c', 'x')) t(a, b)""",
)
def _i3_gaps(spark, sf):
    return rounded(correlation_matrix(view(spark, sf, "outlier_orders").select("x", "c", "k")), 8, "r")


@query(
    "I4_anova_oneway",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
    t AS (SELECT sum(n * m) / sum(n) AS m FROM g),
    s AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * pow(g.m - t.m, 2)) AS between_, sum(n * v) AS within FROM g, t),
    f AS (SELECT groups, n, between_ / (groups - 1) / (within / (n - groups)) AS f, (n - groups) / 2 AS a FROM s),
    x AS (SELECT *, 2 * a / (2 * a + (groups - 1) * f) AS x FROM f)
    SELECT groups::BIGINT AS groups, n::BIGINT AS n, round(f, 8) AS f, round(pow(x, a) * (1 + a * (1 - x)), 8) AS p,
      pow(x, a) * (1 + a * (1 - x)) < 0.05 AS significant FROM x""",
)
def _i4(spark, sf):
    return rounded(anova_oneway(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 8, "f", "p")


@query(
    "I5_scatter_sample",
    f"SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders WHERE {hash_sql('o_orderkey')} / 4503599627370496.0::DOUBLE < 0.1",
)
def _i5(spark, sf):
    return scatter_sample(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 0.1)


CLUSTERED = ["quantity", "discount", "label"]


def _clustered(spark, sf):
    return kmeans(view(spark, sf, "order_lines"), CLUSTERED, k=3)


def _cluster_facts(cols, result):
    """Labels and cost against the centres, by plain arithmetic: every row lies nearest to its own centre."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    gaps = F.array(
        *[
            F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d)
            for c in result.model.clusterCenters()
        ]
    )
    scaled = scaled_inputs(result.labelled, cols).select("cluster", gaps.alias("gaps"))
    own = F.col("gaps")[F.col("cluster")]
    return scaled.agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("cluster").alias("clusters"),
        F.every(own <= F.array_min("gaps") * (1 + 1e-9) + 1e-9).alias("nearest"),
        (F.abs(F.sum(own) / result.inertia - 1) < 1e-6).alias("inertia_agrees"),
    )


@query("J1_kmeans", cte("order_lines") + "SELECT count(*) AS samples, 3::BIGINT AS clusters, true AS nearest FROM order_lines")
def _j1(spark, sf):
    return _cluster_facts(CLUSTERED, _clustered(spark, sf)).drop("inertia_agrees")


@query("J1_kmeans_labels", "SELECT o_orderkey, (o_custkey % 3)::INT AS cluster FROM orders")
def _j1_labels(spark, sf):
    """A label for every order, where three groups lie far apart: k-means finds them, numbered by their place on the line."""
    far = F.col("o_custkey") % 3 * 100 + F.col("o_totalprice") / 1e6
    result = kmeans(table(spark, sf, "orders").select("o_orderkey", far.alias("x"), (F.col("o_custkey") % 3 * 50 + F.col("o_orderkey") % 10 / 10).alias("y")), ["x", "y"], k=3)
    order = sorted(range(3), key=lambda k: result.model.clusterCenters()[k][0])
    place = F.array(*[F.lit(order.index(k)) for k in range(3)])
    return result.labelled.select("o_orderkey", place[F.col("cluster")].alias("cluster"))


@query(
    "J1_kmeans_inputs",
    cte("outlier_orders")
    + """SELECT o_orderkey, round((x - (SELECT avg(x) FROM outlier_orders)) / (SELECT stddev_pop(x) FROM outlier_orders), 8) AS x,
      round((v - (SELECT avg(c) FROM outlier_orders)) / (SELECT stddev_pop(coalesce(c, (SELECT avg(c) FROM outlier_orders))) FROM outlier_orders), 8) AS c
    FROM (SELECT o_orderkey, x, coalesce(c, (SELECT avg(c) FROM outlier_orders)) AS v FROM outlier_orders)""",
)
def _j1_inputs(spark, sf):
    from pyspark.ml.functions import vector_to_array

    scaled = scaled_inputs(view(spark, sf, "outlier_orders").select("o_orderkey", "x", "c"), ["x", "c"])
    parts = vector_to_array("features")
    return scaled.select("o_orderkey", F.round(parts[0], 8).alias("x"), F.round(parts[1], 8).alias("c"))


@query("J1_kmeans_embeddings", "SELECT count(*) AS samples, 10::BIGINT AS clusters, true AS nearest FROM embeddings")
def _j1_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    spread = rows.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return _cluster_facts(names, kmeans(spread, names, k=10)).drop("inertia_agrees")


@query("J2_kmeans_summary", cte("order_lines") + "SELECT 3::BIGINT AS clusters, count(*) AS samples, true AS inertia_agrees FROM order_lines")
def _j2(spark, sf):
    result = _clustered(spark, sf)
    facts = _cluster_facts(CLUSTERED, result).select(F.struct("samples", "inertia_agrees").alias("f")).scalar()
    agrees = facts["inertia_agrees"] & (facts["samples"] == F.col("samples"))
    return kmeans_summary(result).select("clusters", "samples", agrees.alias("inertia_agrees"))
