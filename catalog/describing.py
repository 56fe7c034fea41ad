"""G: descriptive statistics."""

from pyspark.sql import functions as F

from tabwright.operators.describe import (
    box_stats, box_stats_by_group, categorical_summary, density_curve, describe, frequency_table, high_cardinality_warning,
    histogram, numeric_summary, numeric_summary_full, top_values, top_with_others,
)
from tabwright.operators.normality import qq_points
from tabwright.functions.normal import quantile_sql

from . import query
from .views import cte, table, view


def rounded(df, digits: int, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})



def moments_sql(source: str, x: str) -> str:
    """Population skewness and excess kurtosis."""
    return f"""(SELECT round(avg(pow({x} - m, 3)) / pow(avg(pow({x} - m, 2)), 1.5), 6) AS skewness,
      round(avg(pow({x} - m, 4)) / pow(avg(pow({x} - m, 2)), 2) - 3, 6) AS kurtosis
      FROM {source}, (SELECT avg({x}) AS m FROM {source}))"""


NUMERIC = [("l_quantity", 4), ("l_extendedprice", 4), ("l_discount", 4), ("l_tax", 4)]


@query(
    "G1_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c})::BIGINT AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
        max({c}) AS max FROM lineitem"""
        for c, _ in NUMERIC
    ),
)
def _g1(spark, sf):
    lines = table(spark, sf, "lineitem").select(*[c for c, _ in NUMERIC])
    return rounded(describe(lines), 4, "mean", "std", "q25", "q50", "q75")


@query(
    "G1_describe_text",
    """SELECT 'o_orderstatus' AS "column", count(o_orderstatus)::BIGINT AS count, count(DISTINCT o_orderstatus)::BIGINT AS "unique",
      (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
      (SELECT count(*) FROM orders GROUP BY o_orderstatus ORDER BY 1 DESC LIMIT 1)::BIGINT AS freq FROM orders
    UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(DISTINCT o_orderpriority),
      (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      (SELECT count(*) FROM orders GROUP BY o_orderpriority ORDER BY 1 DESC LIMIT 1)::BIGINT FROM orders""",
)
def _g1_text(spark, sf):
    return describe(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


SUMMARY = """round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std,
  min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
  max(l_extendedprice) AS max"""
SHAPE = moments_sql("lineitem", "l_extendedprice")


@query("G2_numeric_summary", f"SELECT s.*, m.* FROM (SELECT {SUMMARY} FROM lineitem) s, {SHAPE} m")
def _g2(spark, sf):
    s = numeric_summary(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(rounded(s, 4, "mean", "median", "std", "q1", "q3"), 6, "skewness", "kurtosis")


@query(
    "G3_numeric_summary_full",
    f"""SELECT s.*, m.* FROM (SELECT count(l_extendedprice)::BIGINT AS count, {SUMMARY},
      round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr,
      round(max(l_extendedprice) - min(l_extendedprice), 4) AS range,
      (count(*) - count(l_extendedprice))::BIGINT AS missing FROM lineitem) s, {SHAPE} m""",
)
def _g3(spark, sf):
    s = numeric_summary_full(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(rounded(s, 4, "mean", "median", "std", "q1", "q3", "iqr", "range"), 6, "skewness", "kurtosis")


@query(
    "G4_categorical_summary",
    cte("dirty_orders")
    + """SELECT count(prio_txt)::BIGINT AS total, count(DISTINCT prio_txt)::BIGINT AS "unique",
      (SELECT prio_txt FROM dirty_orders WHERE prio_txt IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common,
      (SELECT count(*) FROM dirty_orders WHERE prio_txt IS NOT NULL GROUP BY prio_txt ORDER BY 1 DESC LIMIT 1)::BIGINT AS most_common_count,
      (count(*) - count(prio_txt))::BIGINT AS missing FROM dirty_orders""",
)
def _g4(spark, sf):
    return categorical_summary(view(spark, sf, "dirty_orders"), "prio_txt")


@query(
    "G5_frequency_table",
    """SELECT value, cnt, pct, repeat('█', floor(pct / 2)::BIGINT) AS bar FROM (
      SELECT o_orderpriority AS value, count(*)::BIGINT AS cnt, round(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct
      FROM orders GROUP BY o_orderpriority)""",
)
def _g5(spark, sf):
    return frequency_table(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "G6_top_values",
    """SELECT o_custkey AS value, count(*)::BIGINT AS cnt, round(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct
    FROM orders GROUP BY o_custkey ORDER BY cnt DESC, value LIMIT 20""",
)
def _g6(spark, sf):
    return top_values(table(spark, sf, "orders"), "o_custkey", 20)


def _others_sql(source: str, c: str) -> str:
    return f"""SELECT CASE WHEN k <= 10 OR p <= 5 THEN value ELSE 'Others' END AS value, sum(cnt)::BIGINT AS cnt FROM (
      SELECT {c} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {c}) AS p, count(*) OVER () AS k
      FROM {source} GROUP BY {c}) GROUP BY 1"""


@query("G7_top_with_others", _others_sql("part", "p_brand"))
def _g7(spark, sf):
    return top_with_others(table(spark, sf, "part"), "p_brand")


@query("G7_top_with_others_few", _others_sql("orders", "o_orderpriority"))
def _g7_few(spark, sf):
    return top_with_others(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "G8_histogram",
    """WITH e AS (SELECT min(value) AS low, (max(value) - min(value)) / 30 AS w FROM events),
    c AS (SELECT least(floor((value - low) / w), 29)::INT AS bin, count(*) AS cnt FROM events, e GROUP BY 1)
    SELECT i::INT AS bin, round(low + i * w, 6) AS low, round(low + (i + 1) * w, 6) AS high, coalesce(cnt, 0)::BIGINT AS cnt
    FROM range(30) r(i) LEFT JOIN c ON c.bin = i, e""",
)
def _g8(spark, sf):
    return rounded(histogram(table(spark, sf, "events"), "value"), 6, "low", "high")


def _box_sql(source: str, x: str, group: str | None = None) -> str:
    name, by, join = (f"{group} AS \"group\", ", "GROUP BY 1", f"JOIN q ON q.\"group\" = t.{group}") if group else ("", "", ", q")
    head, tail = ('q."group", ', 'GROUP BY ALL') if group else ("", "GROUP BY ALL")
    return f"""WITH q AS (SELECT {name}quantile_cont({x}, 0.25) AS q1, median({x}) AS median, quantile_cont({x}, 0.75) AS q3 FROM {source} {by})
    SELECT {head}round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
      min({x}) FILTER (WHERE {x} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max({x}) FILTER (WHERE {x} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
      count(*) FILTER (WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))::BIGINT AS fliers
    FROM {source} t {join} {tail}"""


@query("G9_box_stats", _box_sql("events", "value"))
def _g9(spark, sf):
    return rounded(box_stats(table(spark, sf, "events"), "value"), 4, "q1", "median", "q3")


@query("G10_box_stats_by_group", _box_sql("events", "value", "event_type"))
def _g10(spark, sf):
    return rounded(box_stats_by_group(table(spark, sf, "events"), "value", "event_type"), 4, "q1", "median", "q3")


@query(
    "G11_qq_points",
    f"""WITH r AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS rank, count(*) OVER () AS total FROM events),
    t AS (SELECT *, CASE WHEN rank = total - 1 THEN pow(0.5e0, 1e0 / total) WHEN rank = 0 THEN 1e0 - pow(0.5e0, 1e0 / total)
      ELSE (rank + 0.6825e0) / (total + 0.365e0) END AS p FROM r),
    q AS (SELECT *, {quantile_sql('p')} AS theoretical, greatest(1e0, (total - 1) / 999) AS thin FROM t)
    SELECT rank::BIGINT AS rank, round(theoretical, 8) AS theoretical, x AS value, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r
    FROM q, (SELECT regr_slope(x, theoretical) AS slope, regr_intercept(x, theoretical) AS intercept, corr(x, theoretical) AS r FROM q)
    WHERE round(round(rank / thin) * thin) = rank""",
)
def _g11(spark, sf):
    return rounded(rounded(qq_points(table(spark, sf, "events"), "value"), 6, "slope", "intercept", "r"), 8, "theoretical")


@query(
    "G12_density_curve",
    """WITH f AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h, min(value) - (max(value) - min(value)) / 2 AS start,
      (max(value) - min(value)) * 2 / 999 AS step FROM events),
    v AS (SELECT value AS v, count(*) AS cnt FROM events GROUP BY value)
    SELECT i::BIGINT AS point, round(start + i * step, 6) AS x, round(sum(cnt * exp(-pow((start + i * step - v) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 10) AS density
    FROM range(1000) r(i), f, v GROUP BY i, start, step""",
)
def _g12(spark, sf):
    return rounded(rounded(density_curve(table(spark, sf, "events"), "value"), 6, "x"), 10, "density")


@query(
    "G13_high_cardinality_warning",
    """SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey)::BIGINT AS n_unique, count(DISTINCT o_custkey) > 50 AS high_cardinality FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::BIGINT, count(DISTINCT o_orderpriority) > 50 FROM orders""",
)
def _g13(spark, sf):
    orders = table(spark, sf, "orders")
    return high_cardinality_warning(orders, "o_custkey").unionByName(high_cardinality_warning(orders, "o_orderpriority"))
