"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch


def _lowest(pairs: DataFrame, upper_only: bool) -> DataFrame:
    """For each u the least of its neighbours and itself, beside each neighbour v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(low, "u")
    return joined.where(F.col("v") > F.col("u")) if upper_only else joined


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (a, b).

    Alternating stars: first every node hands its larger neighbours the least node it knows, then
    its smaller ones, until no edge moves; the number of rounds grows with the logarithm of a
    component's length. Each round is written to the shared folder. Aggregations combine
    before the shuffle, so a node with very many links is no hot group.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.keep(edges, f"{name}0")
    size, k = edges.count(), 0
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, True).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lowest(large, False)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, scratch.keep(star.where("u <> v").distinct(), f"{name}{k + 1}")
        still = edges.count() == size and edges.join(before, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}{k}")
        size, k = edges.count(), k + 1
        if still:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
