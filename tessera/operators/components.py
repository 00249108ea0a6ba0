"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b) that is not itself the smallest of its component.

    Large and small stars by turns (Kiveris et al., 2014): neighbours are hung onto the smallest node around until each
    component is one star. Minima are combined before they are shuffled; no node's neighbours are gathered in a list.
    """
    at = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, at = at, materialize(small, "stars")
        discard(old)
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
