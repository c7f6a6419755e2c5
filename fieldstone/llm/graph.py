"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.text import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the smallest node it reaches.

    Alternating large-star and small-star steps on the table of links, whose size never grows; each
    step takes the smallest neighbour by a combined aggregate and joins it back, so a hub with very
    many links is split like any skewed join. Steps are written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, "links")
    state = None
    while True:
        large = _star(edges.union(edges.select("v", "u")), F.col("w") > F.col("u"))
        before, edges = edges, written(_star(large, F.lit(True)), "links")  # large-star leaves u > v: the small star's input
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def _star(edges: DataFrame, keep) -> DataFrame:
    """Link each neighbour ``w`` of u that is kept, and u itself, to the smallest of u and its neighbours."""
    edges = edges.toDF("u", "w")
    least = edges.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = edges.join(least, "u").where(keep).select(F.col("w").alias("u"), F.col("m").alias("v"))
    out = moved.union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
