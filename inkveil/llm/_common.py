"""Shared Spark helpers: durable intermediate tables, components, gapless numbers."""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import storage
from ..storage import drop_stored, new_path, shared_dir  # noqa: F401


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, where the session has Spark's default: texts are long, and workers keep what they once took."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def stored(df: DataFrame, name: str) -> DataFrame:
    """storage.stored with small Arrow batches."""
    small_batches(df.sparkSession)
    return storage.stored(df, name)


def passing(df: DataFrame, name: str) -> AbstractContextManager[DataFrame]:
    """storage.passing with small Arrow batches."""
    small_batches(df.sparkSession)
    return storage.passing(df, name)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty; other columns, whatever their names, are dropped."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Add `name`: numbers 0, 1, ... without gaps within each group, also where one group holds most rows.

    Rows are dealt to hashed buckets of their group, ranked there, and moved up by the
    sizes of the buckets before: no task sees a whole group. Ties in `order` are
    rows alike in all columns, so either order gives the same result.
    """
    n = buckets or 4 * partitions(df.sparkSession)
    salted = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n)).cast("int"))
    before = (
        salted.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n"))
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    return (
        salted.withColumn("_r", rank).join(before, [*group, "_b"])
        .withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node above has one edge, and to a node that has none above itself: then each edge leads to its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as longs (u, v); component: its smallest node.

    Alternating large-star and small-star steps: O(log^2) rounds, each linear in the
    edges, written to the shared folder; none for edges that lead to their component already, as a round has
    many exchanges, and each costs the driver memory. Nodes without edges aren't in the result. Raises
    RuntimeError where the rounds don't suffice.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    done = _settled(e)
    for _ in range(rounds):
        if done:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        done = _settled(e)
    if not done:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


LONG, INT, STRING, BINARY, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType()
