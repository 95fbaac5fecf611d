"""Connected components of link tables, by alternating star steps.

Every step replaces the links of a node by links to the smallest node it knows;
large steps move larger neighbours, small steps the rest.  Links turn into stars
around the smallest node of each component in a few rounds, also for long chains.
Each round is written to the shared folder, which cuts the lineage and survives
lost executors.  A node with very many links is reduced before it is shuffled,
and Spark splits it in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch


def _kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, "stars")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node but each component's smallest.

    *links* has two long columns ``a, b`` in any order; repeated links and links
    of a node to itself do no harm.
    """
    state = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        print_ = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if print_ == seen or print_[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = print_
        state = _kept(_small(_large(state)))
