"""Connected components by distributed union-find (large-star and small-star rounds), with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from .common import Scratch


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(a.alias("u"), b.alias("v"))


def _state() -> list[Column]:
    """How many links there are, and a sum of their hashes."""
    apart = F.col("u") != F.col("v")
    return [F.count(F.when(apart, 1)).alias("n"), F.sum(F.when(apart, F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("h")]


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (its first two columns, of one ordered type); the component is its smallest node.

    Loops and repeated edges do no harm; rows with a null end are ignored; nodes without an edge are not returned. Each round is one job, written
    to the shared folder, which cuts the lineage; the job also observes whether anything moved, so that stars end with the first. A hub's edges meet
    in joins, whose skewed partitions Spark splits, and its minimum is pre-aggregated; what a node's smaller neighbours are tied to is told by one
    shuffle, through which a node with very many of them streams.
    """
    scratch = scratch or Scratch(spark, "components")
    a, b = edges.columns[:2]
    start = _pairs(edges, F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))).where("u is not null and v is not null")
    seen = Observation()
    now = scratch.write(start.distinct().observe(seen, *_state()), "edges")
    nodes_of_loops = now.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    links = now.where("u <> v")
    before, last = (seen.get["n"], seen.get["h"]), None
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: every neighbour above a node is tied to the smallest of that node's neighbourhood; no more rows than there were
        both = links.union(_pairs(links, F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _pairs(both.where("v > u").join(least, "u"), F.col("v"), F.col("m"))
        # small star: a node and its smaller neighbours are tied to the smallest of them, of whose rows one ties the node itself
        near = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = _pairs(near, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")), F.col("m")).distinct()
        seen = Observation()
        links = scratch.write(small.observe(seen, *_state()), "star")
        if last is not None:
            scratch.drop(last)
        last, state = links, (seen.get["n"], seen.get["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*")
    return ends.union(nodes_of_loops).groupBy("node").agg(F.min("component").alias("component"))


def joined_components(spark: SparkSession, comps: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the graph that had ``comps`` (``node, component``) once the links ``more`` (``a, b``) are added; only the contracted links are walked."""
    for end in ("a", "b"):
        own = comps.select(F.col("node").alias(end), F.col("component").alias("__c"))
        more = more.join(own, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    renamed = scratch.write(connected_components(spark, more.select("a", "b").distinct(), scratch), "renamed")
    moved = comps.join(renamed.select(F.col("node").alias("component"), F.col("component").alias("__c")), "component", "left").select("node", F.coalesce("__c", "component").alias("component"))
    fresh = renamed.join(comps, "node", "left_anti").select("node", "component")
    return moved.unionByName(fresh)
