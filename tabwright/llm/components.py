"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import drop_path, fresh_path


#: Edges that a task should hold while a table has up to ``FEW`` of them; rounds are many, so tiny tasks would cost more than the work.
EDGES_PER_TASK, FEW = 20_000, 2_000_000


def _tasks(edges: int) -> int | None:
    """Tasks for a table of so many edges; None leaves larger tables as they are dealt."""
    return max(1, -(-edges // EDGES_PER_TASK)) if edges <= FEW else None


def _packed(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def _are_stars(edges: DataFrame, tasks: int | None) -> bool:
    """Whether every node has one smaller neighbour that has none itself: then another round changes nothing."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not _packed(each, tasks).filter("up > 1 or (up = 1 and down = 1)").count()


class _Tables:
    """Tables in the shared folder, so that a lost executor costs one round at most. Unlike checkpoints they carry no sort orders
    on from join to join, which would double with every round and planning with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "stars")
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            drop_path(self.spark, self.paths.pop(id(df))[0])


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every node of ``edges`` (``u``, ``v``; both long): ``root`` is the smallest node it reaches.

    Each round makes every node point nearer to its smallest neighbour; the number of rounds grows with the logarithm of the
    longest path. Smallest neighbours are written before they are joined with the edges, so that the join can split a hot
    node. The tables of a round are deleted after the next. Nulls and loops are left out.
    """
    tables, tasks = _Tables(edges.sparkSession), None

    def keep(df: DataFrame) -> DataFrame:
        return tables.keep(_packed(df, tasks))

    def nearest(edges: DataFrame) -> DataFrame:
        return keep(edges.groupBy("u").agg(F.min("v").alias("m")))

    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    # No round makes more edges than this and one for each node.
    tasks = _tasks(now.count())
    while not _are_stars(now, tasks):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = nearest(both)
        large = keep(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        tables.drop(now, near)
        near = nearest(large)
        small = large.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.union(near.select("u", F.col("m").alias("v"))).distinct())
        tables.drop(large, near)
    leaves = now.select("u", F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
