"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the edges (a, b): comp is the smallest node reachable; nodes without edges do not appear.

    Each round joins every node's neighbours to its smallest one, first the
    greater neighbours, then the smaller; the rounds grow with the logarithm of
    the component, not with its diameter.  Each round is written to the shared
    folder.  Hot nodes are only grouped by minima (combined map-side) and joined.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: greater neighbours point to the smallest of the neighbourhood
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        # small star: a node and its smaller neighbours point to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
