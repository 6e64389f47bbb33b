"""Typed edge tables: neighbours, bounded traversal, in-degree, PageRank, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, of: DataFrame, direction: str = "forward", types: list[str] | None = None) -> DataFrame:
    """(id, neighbour, type): one row for each edge at a vertex of `of`."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return e.select(F.col(a).alias("id"), F.col(b).alias("neighbour"), "type").join(of, "id", "left_semi")


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of vertices within `hops` of `start`, by breadth; a join for each hop."""
    seen = start.select("id", F.lit(0).alias("depth"))
    for k in range(1, hops + 1):
        step = seen.where(F.col("depth") == k - 1).join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id"), F.lit(k).alias("depth"))
        seen = seen.unionByName(step).groupBy("id").agg(F.min("depth").alias("depth"))
    return seen


def in_degree(nodes: DataFrame, edges: DataFrame, kind: str = "invokes") -> DataFrame:
    """(id, in_degree) by edges of one kind, parallel ones counted; vertices without any: 0."""
    counts = edges.where(F.col("type") == kind).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float = 1e-6, kind: str = "invokes") -> DataFrame:
    """(id, rank) of the vertices of distinct edges of one kind; dangling mass is shared by all.

    Rounds end when the ranks change by less than n * tolerance together, or after `rounds`. Every fourth round
    ranks are written to the checkpoint folder, where the cluster names one, so plans stay short and survive lost executors.
    """
    links = edges.where(F.col("type") == kind).select("src", "dst").distinct()
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lasting = edges.sparkSession.conf.get("spark.checkpoint.dir", None) or edges.sparkSession.sparkContext.getCheckpointDir()
    out = links.groupBy("src").agg(F.count("*").alias("deg"))
    n = nodes.agg(F.count("*").alias("n"))
    rank = nodes.select("id").join(F.broadcast(n)).select("id", (1 / F.col("n")).alias("rank"), "n")  # one row
    for k in range(1, rounds + 1):
        before = rank
        sent = links.join(out, "src").join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        loose = rank.join(out.select(F.col("src").alias("id")), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        rank = rank.join(sent, "id", "left").join(F.broadcast(loose))  # one row
        rank = rank.select("id", ((1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))).alias("rank"), "n")
        if tolerance and k % 4 == 0:
            rank = rank.checkpoint() if lasting else rank.cache()
            gap = rank.join(before.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.max("n")).first()
            if gap[0] is None or gap[0] < gap[1] * tolerance:
                break
    return rank.select("id", "rank")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: a keyed upsert."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def overlapping(blocks: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Pairs (block, span) of one file whose line ranges [start, end] overlap.

    Both sides fall into buckets of `width` lines and join by (file, bucket); a pair that shares several
    buckets counts in the first of them.
    """
    def dealt(df, p):
        buckets = F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor(F.col(f"{p}_end") / width))
        return df.withColumn("_bucket", F.explode(buckets))

    both = dealt(blocks, "b").join(dealt(spans, "s"), ["file", "_bucket"])
    first = F.col("_bucket") == F.floor(F.greatest("b_start", "s_start") / width)
    return both.where(first & (F.col("b_start") <= F.col("s_end")) & (F.col("b_end") >= F.col("s_start"))).drop("_bucket")
