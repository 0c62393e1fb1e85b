"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans.stage import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b: long); the component is its smallest id.

    Each round replaces links by links to smaller ids until all are stars, in a
    number of rounds that grows with the logarithm of the longest chain. Minima
    are combined before the shuffle and joins spread a crowded id, so a hub with
    a third of all links is no burden for one task. Every round is written.
    """
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(large.distinct(), "links")
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        small = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where("a <> b")
        links = stage(small.distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = links.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
