"""Connected components of an edge table, with alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): each vertex of edges (u, v) with the smallest vertex that it reaches.

    Large-star and small-star steps in turn until the edges stay as they are. Each step is an
    aggregation with partial sums and a join, so a vertex with many links is split over tasks.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u < v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v: the centre
        least = both.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m")).withColumn("m", F.least("c", "m"))
        large = both.join(least, F.col("v") == F.col("c")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        down = large.where("u < v").distinct()
        low = down.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        small = down.join(low, F.col("v") == F.col("c")).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        e = cut(small.where("u < v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first()
        if now == before:
            return e.groupBy("v").agg(F.min("u").alias("comp")).union(e.select(F.col("u").alias("v"), F.col("u").alias("comp")).distinct())
        before = now
