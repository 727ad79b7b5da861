"""Links inside hash buckets and the components that links make, without pairing whole buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Buckets up to this size are paired in full; a row has at most so many partners there.
SMALL = 32
#: In a larger bucket every row is compared with so many hubs.
HUBS = 3


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (nid, comp) for every end of an edge (a, b); comp is the smallest id it is linked to.

    Alternates hanging larger neighbours, then smaller ones, under the least neighbour until only
    stars are left. Each step is a minimum per node (combined before its shuffle) and a join of
    written tables, so that AQE can split the edges of a hub; a lost executor repeats one step at most. No edges give no rows.
    """
    forest = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "forest")
        forget(forest, least, large, down)
        forest = now
        ends = forest.select(F.col("u").alias("nid"), F.lit(1).alias("child"), F.lit(0).alias("head")).unionByName(forest.select(F.col("v").alias("nid"), F.lit(0).alias("child"), F.lit(1).alias("head")))
        if ends.groupBy("nid").agg(F.sum("child").alias("child"), F.max("head").alias("head")).where("child > 1 or (child = 1 and head = 1)").isEmpty():
            break
    roots = forest.select(F.col("v").alias("nid")).distinct()
    return stored(forest.select(F.col("u").alias("nid"), F.col("v").alias("comp")).unionByName(roots.select("nid", F.col("nid").alias("comp"))), "components")


def _top(rows: DataFrame, *order: Column) -> DataFrame:
    """The first ``HUBS`` rows of each bucket; tasks cut their share before the shuffle."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order, "nid"))
    return stored(rows.select("key", "nid", "w").withColumn("place", place).where(F.col("place") <= HUBS).select("key", F.col("nid").alias("hub")), "hubs")


def _pairs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    near = rows.join(hubs, "key").where("nid <> hub")
    return near.select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b"))


def link(bands: DataFrame, prepare: Callable[[DataFrame], tuple[Callable, Callable]]) -> DataFrame:
    """Verified links (a, b), a < b, among rows that share a band; ``bands`` has (key, nid, w), w a row's copies.

    ``prepare`` gets the rows of buckets with company and returns the check that keeps the
    linked ones of candidate pairs, and what compares the rest of large buckets (its links may
    name a component for any row of it). Small buckets are paired in full. In a large one each row meets
    the hubs, the rows with the most copies; rows that this joins to the bucket's main component need no
    more. Those that stay outside are the rest: they are compared with every row of the
    bucket in another component. So rows of a large group of copies make a few pairs each.
    """
    counts = stored(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    multi = stored(bands.join(counts, "key"), "buckets")
    check, rest = prepare(multi)
    few = multi.where(F.col("size") <= SMALL).select("key", "nid")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.nid") < F.col("y.nid"))).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))
    large = multi.where(F.col("size") > SMALL).select("key", "nid", "w")
    if large.isEmpty():
        return stored(check(pairs.distinct()), "links")
    hubs = _top(large, F.col("w").desc(), F.xxhash64("nid"))
    found = stored(check(pairs.unionByName(_pairs(large, hubs)).distinct()), "links")
    rows = stored(large.join(components(found), "nid", "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp")), "rows")
    main = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    tagged = stored(rows.join(stored(main, "main"), "key"), "tagged")
    away = tagged.where("comp <> main")
    if away.isEmpty():
        return found
    return found.unionByName(stored(rest(away, tagged), "more-links")).distinct()
