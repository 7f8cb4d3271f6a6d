"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge joins to another; component is the smallest id reachable.

    Each step points neighbours at the smallest id seen, so the edges shrink to one star per
    component in logarithmically many rounds. A hub is a skewed join key of 16-byte rows, never a
    collected list: minima are pre-aggregated and AQE splits the join. Every round is checkpointed.
    Edges with a null end and loops are left out. An empty input gives no rows.
    """
    e = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u is not null and v is not null and u <> v and {0} is not null and {1} is not null".format("u", "v"))
        .distinct()
    )
    while True:
        roles = (
            e.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("node"), "n", F.lit(0).alias("parent"))
            .unionByName(e.select(F.col("v").alias("node"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("parent")))
            .groupBy("node").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))
        )
        if roles.filter("n > 1 or (n > 0 and parent = 1)").limit(1).count() == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = _least(large)
        e = cut(
            large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        )
