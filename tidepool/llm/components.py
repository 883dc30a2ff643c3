"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import saved


def _star(edges: DataFrame) -> DataFrame:
    """For directed rows (u, v): the smallest of u and its v, joined back to every v. Sums before the shuffle; a hot u can be split."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges(a, b) of type long -> (node, root): root is the smallest node reachable. Nodes without an edge do not appear.

    Nulls and loops in edges are ignored; repeated edges change nothing; no edges give no rows.
    Each round is written to the shared folder, so that neither the plan nor the recovery grows with the rounds.
    """
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = saved(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
