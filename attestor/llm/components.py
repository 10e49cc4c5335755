"""Connected components of a link table by alternating large-star and small-star steps, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, root), root being the smallest node reachable; nodes without a link are left out.

    Each round is checkpointed in the shared folder, so losing an executor costs no more than a round.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = shared(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    digest = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        edges = shared(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == digest:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        digest = now
