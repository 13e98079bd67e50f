"""Connected components of links, as rounds of grouped minima over the links; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteq.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of the links (a, b), the smallest id that it reaches.

    Alternates large and small stars: every node points its larger neighbours, then all its neighbours, to its least
    one, until no link changes; then each node's only link is to the least node of its component. A hub's links are
    reduced by map-side minima, and the number of links never grows. Rounds grow with the logarithm of the longest path;
    there are as many as it takes, since every round but the last moves a link to a smaller end.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before, after = None, _mark(edges)
    while after[0] and after != before:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        edges = written(small)
        before, after = after, _mark(edges)
    ends = edges.groupBy("v").agg(F.min("u").alias("u"))
    roots = edges.select(F.col("u").alias("v")).distinct().join(edges.select("v"), "v", "left_anti").select("v", F.col("v").alias("u"))
    return ends.union(roots).select(F.col("v").alias("id"), F.col("u").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sums of the links: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
