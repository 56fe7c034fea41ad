"""H: normality tests and transforms."""

from pyspark.sql import functions as F

from tabwright.functions.normal import log_upper_tail_sql, quantile_sql
from tabwright.operators.normality import (
    anderson_darling, normality_report, recommend_transform, shapiro_wilk, transform,
)

from . import query
from .describing import moments_sql, rounded
from .views import table


def _shapiro_sql(source: str, x: str) -> str:
    """CTEs ending in ``shapiro(n, w, p)``, for n of at least 12."""
    m = quantile_sql("(rank - 0.375e0) / (n + 0.25e0)")
    return f"""ranked AS (SELECT {x} AS x, row_number() OVER (ORDER BY {x}) AS rank, count(*) OVER () AS n FROM {source} WHERE {x} IS NOT NULL),
    scored AS (SELECT *, {m} AS m FROM ranked),
    sums AS (SELECT any_value(n)::DOUBLE AS n, sum(m * m) AS mm, max(m) AS mn, max(m) FILTER (WHERE rank = n - 1) AS mn1, 1 / sqrt(any_value(n)) AS u,
      sum(m * x) FILTER (WHERE rank BETWEEN 3 AND n - 2) AS middle, var_pop(x) * any_value(n) AS ss,
      max(x) - min(x) AS outside, max(x) FILTER (WHERE rank = n - 1) - max(x) FILTER (WHERE rank = 2) AS inside FROM scored),
    weights AS (SELECT *,
      mn / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS an,
      mn1 / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS an1 FROM sums),
    stat AS (SELECT n, pow(middle / sqrt((mm - 2 * mn ** 2 - 2 * mn1 ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)) + an * outside + an1 * inside, 2) / ss AS w,
      ln(n) AS l FROM weights),
    zed AS (SELECT n, w, (ln(1 - w) - (0.0038915 * l ** 3 - 0.083751 * l ** 2 - 0.31082 * l - 1.5861)) / exp(0.0030302 * l ** 2 - 0.082676 * l - 0.4803) AS z FROM stat),
    shapiro AS (SELECT n, w, exp({log_upper_tail_sql('z')}) AS p FROM zed)"""


def _anderson_sql(source: str, x: str) -> str:
    """CTEs ending in ``anderson(a2)``."""
    return f"""az AS (SELECT ({x} - m) / s AS z, row_number() OVER (ORDER BY {x}) AS i, n
      FROM {source}, (SELECT avg({x}) AS m, stddev_samp({x}) AS s, count({x}) AS n FROM {source})),
    anderson AS (SELECT -any_value(n) - sum((2 * i - 1) * ({log_upper_tail_sql('-z')}) + (2 * (n - i) + 1) * ({log_upper_tail_sql('z')})) / any_value(n) AS a2 FROM az)"""


@query(
    "H1_shapiro_wilk",
    f"""WITH {_shapiro_sql('customer', 'c_acctbal')}
    SELECT n::BIGINT AS n, round(w, 8) AS w, round(p, 8) AS p, p > 0.05 AS normal, n <= 5000 AS p_reliable FROM shapiro""",
)
def _h1(spark, sf):
    return rounded(shapiro_wilk(table(spark, sf, "customer"), "c_acctbal"), 8, "w", "p")


@query(
    "H2_anderson_darling",
    f"WITH {_anderson_sql('events', 'value')} SELECT (SELECT count(value) FROM events)::BIGINT AS n, round(a2, 4) AS a2 FROM anderson",
)
def _h2(spark, sf):
    return rounded(anderson_darling(table(spark, sf, "events"), "value"), 4, "a2")


@query(
    "H3_normality_report",
    f"""WITH {_shapiro_sql('part', 'p_retailprice')}, {_anderson_sql('part', 'p_retailprice')}
    SELECT n::BIGINT AS n, round(w, 8) AS w, round(p, 8) AS p, round(a2, 4) AS a2, skewness, kurtosis, p > 0.05 AS normal, n <= 5000 AS p_reliable
    FROM shapiro, anderson, {moments_sql('part', 'p_retailprice')}""",
)
def _h3(spark, sf):
    report = normality_report(table(spark, sf, "part"), "p_retailprice")
    return rounded(rounded(rounded(report, 8, "w", "p"), 4, "a2"), 6, "skewness", "kurtosis")


@query(
    "H4_recommend_transform",
    """WITH m AS (SELECT abs(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)) AS s, bool_or(value <= 0) AS blocked
      FROM events, (SELECT avg(value) AS m FROM events)),
    shape AS (SELECT s, CASE WHEN s > 2 THEN CASE WHEN blocked THEN 'b' ELSE 'a' END WHEN s > 1 THEN CASE WHEN blocked THEN 'd' ELSE 'c' END ELSE 'e' END AS k FROM m)
    SELECT place::INT AS place, method, rating, round(s, 6) AS skewness FROM shape JOIN (VALUES
      ('a', 1, 'Log', 'best'), ('a', 2, 'Box-Cox', 'good'), ('a', 3, 'Yeo-Johnson', 'ok'), ('b', 1, 'Yeo-Johnson', 'only'), ('b', 2, 'Box-Cox', 'cannot use'),
      ('c', 1, 'Square Root', 'best'), ('c', 2, 'Log', 'good'), ('c', 3, 'Yeo-Johnson', 'ok'), ('d', 1, 'Yeo-Johnson', 'best'),
      ('e', 1, 'Z-Score', 'best'), ('e', 2, 'Min-Max', 'ok')) t(k, place, method, rating) USING (k)""",
)
def _h4(spark, sf):
    return rounded(recommend_transform(table(spark, sf, "events"), "value"), 6, "skewness")


def _simple(name, method, source, key, x, expression):
    @query(name, f"SELECT {key}, round({expression}, 8) AS transformed FROM {source}")
    def run(spark, sf):
        done = transform(table(spark, sf, source).select(key, x), x, method)
        return done.select(key, F.round("transformed", 8).alias("transformed"))


_simple("H5_transform_log", "Log", "orders", "o_orderkey", "o_totalprice", "ln(o_totalprice)")
_simple("H6_transform_sqrt", "Square Root", "orders", "o_orderkey", "o_totalprice", "sqrt(o_totalprice)")
_simple(
    "H9_transform_zscore", "Z-Score", "customer", "c_custkey", "c_acctbal",
    "(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer)",
)
_simple(
    "H10_transform_minmax", "Min-Max", "customer", "c_custkey", "c_acctbal",
    "(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer))",
)


def _lambda_sql(source: str, x: str, power: str, jacobian: str) -> str:
    """Three grid passes over the power and a parabola; ``power`` uses ``lam``."""
    passes = []
    for i in range(1, 4):
        low = "-2e0" if i == 1 else f"(SELECT low FROM best{i - 1})"
        high = "2e0" if i == 1 else f"(SELECT high FROM best{i - 1})"
        passes.append(
            f"""grid{i} AS (SELECT i, {low} + i * (({high} - {low}) / 40) AS lam, (({high} - {low}) / 40) AS step FROM range(41) r(i)),
            score{i} AS (SELECT i, lam, any_value(step) AS step, -count(*) / 2 * ln(var_pop({power})) + (lam - 1) * sum({jacobian}) AS score
              FROM {source}, grid{i} GROUP BY i, lam),
            near{i} AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS c, lag(lam) OVER w AS low, lead(lam) OVER w AS high FROM score{i} WINDOW w AS (ORDER BY i)),
            best{i} AS (SELECT * FROM near{i} ORDER BY score DESC, i LIMIT 1)"""
        )
    return "WITH " + ", ".join(passes) + ", found AS (SELECT round(lam + step * (a - c) / (2 * (a - 2 * score + c)), 6) AS lam FROM best3)"


BOXCOX = "(pow({x}, lam) - 1) / lam"
YEO = "CASE WHEN {x} >= 0 THEN (pow({x} + 1, lam) - 1) / lam ELSE -(pow(1 - {x}, 2 - lam) - 1) / (2 - lam) END"


def _fitted(name, method, source, key, x, power, jacobian, digits):
    # At exactly 0 the power is the logarithm; a grid point this close gives the same score.
    safe = power.format(x=x).replace("lam", "(CASE WHEN abs(lam) < 1e-12 THEN 1e-9 WHEN abs(lam - 2) < 1e-12 THEN 2 - 1e-9 ELSE lam END)")
    sql = _lambda_sql(source, x, safe, jacobian) + f" SELECT {key}, round({power.format(x=x)}, {digits}) AS transformed FROM {source}, found"

    @query(name, sql)
    def run(spark, sf):
        done = transform(table(spark, sf, source).select(key, x), x, method)
        return done.select(key, F.round("transformed", digits).alias("transformed"))


_fitted("H7_transform_boxcox", "Box-Cox", "part", "p_partkey", "p_retailprice", BOXCOX, "ln(p_retailprice)", 4)
_fitted("H8_transform_yeojohnson", "Yeo-Johnson", "events", "event_id", "value", YEO, "sign(value) * ln(abs(value) + 1)", 4)
