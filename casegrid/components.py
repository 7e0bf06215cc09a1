"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegrid.workspace import discard, materialize


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Point every neighbour (larger ones only, or smaller ones only) of a node to the node's least neighbour."""
    both = links.union(links.select("b", "a")).toDF("u", "v") if larger else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["k"])
    if larger:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("k").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b): the least node it can reach.

    Every round points neighbours to the least neighbour (larger ones, then
    smaller ones), writes the shrunken links to the shared folder and stops when
    they no longer change; rounds grow with the logarithm of the longest path.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = sign(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        before, links = links, materialize(_stars(_stars(links, True), False), "links")
        discard(before)
        now = sign(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct().toDF("node", "component"))
