"""Input views over the given tables. The same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ``{S}`` is the string type. Every view covers its whole base table.
VIEWS = {
    "dirty_orders": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'n/a'
       ELSE concat('$', cast(cast(o_totalprice AS decimal(18,2)) AS {S})) END AS price_txt,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_num,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('  ', lower(o_orderpriority), '! ')
       WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS prio_txt
FROM orders""",
    "mixed_orders": """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 23 = 0 THEN concat(cast(cast(o_totalprice AS decimal(18,2)) AS {S}), ' EUR')
       WHEN o_orderkey % 29 = 0 THEN NULL
       ELSE cast(cast(o_totalprice AS decimal(18,2)) AS {S}) END AS price_txt,
  concat(o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '!' ELSE '' END) AS status_txt,
  substr(cast(o_orderdate AS {S}), 1, 10) AS date_txt,
  o_orderpriority
FROM orders""",
    "dirty_part": """
SELECT p_partkey,
  concat(cast(p_size AS {S}), CASE WHEN p_partkey % 3 = 0 THEN ' kg' WHEN p_partkey % 3 = 1 THEN 'cm' ELSE ' km/h' END) AS size_txt,
  concat(cast(cast(p_size AS decimal(10,1)) AS {S}), '%') AS pct_txt,
  concat(cast(p_partkey % 9 + 1 AS {S}), ',', lpad(cast(p_partkey % 1000 AS {S}), 3, '0'), '.50') AS thousands_txt,
  concat('  ', cast(cast(p_retailprice AS decimal(18,2)) AS {S}), ' ') AS padded_txt,
  concat(' ', upper(p_name), '   no. ', cast(p_size AS {S}), '_#x ') AS name_txt,
  CASE WHEN p_partkey % 6 = 0 THEN 'N/A' WHEN p_partkey % 6 = 1 THEN ' unknown ' WHEN p_partkey % 6 = 2 THEN 'banana'
       WHEN p_partkey % 6 = 3 THEN '-' WHEN p_partkey % 6 = 4 THEN NULL ELSE p_type END AS marker_txt
FROM part""",
    "dup_lineitem": """
SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R'""",
    "outlier_orders": """
SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS x,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(o_custkey AS double) END AS c, cast(1 AS double) AS k
FROM orders""",
    "order_lines": """
SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, avg(l_discount) AS discount,
  sum(l_extendedprice) AS label, min(l_returnflag) AS flag
FROM lineitem GROUP BY l_orderkey""",
    "activity": """
SELECT event_id, ts, user_id, event_type AS type, value FROM events""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, over temporary views of the tables it names."""
    text = VIEWS[name].format(S="string")
    for base in TABLES:
        if f" {base}" in text:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)


def cte(*names: str) -> str:
    """``WITH`` clause that defines the views for the checking engine."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(S='varchar')})" for n in names) + " "


def hash_sql(key: str, seed: int | str = 42, digits: int = 13) -> str:
    """The hash number of a key, as SQL."""
    return f"('0x'||substr(md5(concat(cast({key} AS varchar),'|{seed}')),1,{digits}))::BIGINT"
