"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import column, table

#: Vectors of a shard (mean), edges of a vertex, width of the beam, vertices expanded at once, entries.
SHARD, DEGREE, BEAM, AT_ONCE, ENTRIES = 4096, 24, 64, 4, 32
BLOCK = 512
#: Groups of shards that the queries are sent to.
LANES = 64


def search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search for all rows of q at once: ids and similarities, best first, -1 where none."""
    n, m = len(x), len(q)
    ids = np.full((m, beam), -1, np.int64)
    near = np.full((m, beam), -np.inf, np.float32)
    entry = entry[:beam]
    width = len(entry)
    ids[:, :width], near[:, :width] = entry, q @ x[entry].T
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    open_ = np.zeros((m, beam), bool)
    open_[:, :width] = True
    active = np.arange(m)
    while len(active):
        score = np.where(open_[active], near[active], -np.inf)
        pick = np.argpartition(-score, min(AT_ONCE, beam - 1), axis=1)[:, :AT_ONCE]
        ok = np.take_along_axis(score, pick, 1) > -np.inf
        rows = np.arange(len(active))[:, None]
        open_[active[:, None], pick] = False
        from_ = np.where(ok, ids[active[:, None], pick], -1)
        found = np.where(from_[:, :, None] >= 0, edges[from_], -1).reshape(len(active), -1)
        new = (found >= 0) & ~seen[active[:, None], found]
        order = np.argsort(found, axis=1)  # a vertex may be met twice in a step
        twice = np.zeros_like(new)
        sorted_ = np.take_along_axis(found, order, 1)
        np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
        new &= ~twice
        seen[active[:, None], np.where(new, found, entry[0])] = True
        s = np.where(new, np.einsum("mkd,md->mk", x[found], q[active]), -np.inf)
        all_near = np.concatenate([near[active], s], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active] = np.concatenate([ids[active], found], axis=1)[rows, top]
        near[active] = all_near[rows, top]
        open_[active] = np.concatenate([open_[active], new], axis=1)[rows, top]
        open_[active] &= near[active] > -np.inf
        active = active[open_[active].any(axis=1)]
    ids[near == -np.inf] = -1
    return ids, near


def prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse edges for the vertices p out of candidates (rows, -1 where none): the nearest is taken, and
    all that are alpha times nearer to it than to the vertex leave; then again."""
    cand = np.where(cand == p[:, None], -1, cand)
    order = np.argsort(cand, axis=1)
    c = np.take_along_axis(cand, order, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[c]
    d = np.where(c >= 0, 1 - np.einsum("mkd,md->mk", v, x[p]), np.inf)
    out = np.full((len(p), degree), -1, np.int64)
    rows = np.arange(len(p))
    for k in range(degree):
        best = d.argmin(axis=1)
        ok = d[rows, best] < np.inf
        if not ok.any():
            break
        out[ok, k] = c[rows, best][ok]
        between = 1 - np.einsum("mkd,md->mk", v, v[rows, best])
        # distances are squared ones of unit vectors, so alpha is squared too
        d = np.where(alpha * alpha * between <= d, np.inf, d)
        d[rows, best] = np.inf
    return out


def entries(x: np.ndarray) -> np.ndarray:
    """Where searches begin: the vertex nearest to the mean, then each the farthest from those before, so
    that a dense group of near copies never holds all of them."""
    out = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[out[0]]
    while len(out) < min(ENTRIES, len(x)):
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    return np.array(list(dict.fromkeys(out)))


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertices, degree) and the entries of a graph over unit vectors, in two passes of insertions."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = entries(x)
    edges = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1)
    edges[edges == np.arange(n)[:, None]] = -1
    for alpha in (1.0, 1.2):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            p = order[lo : lo + batch]
            found, _ = search(x, edges, entry, x[p], beam)
            edges[p] = prune(x, p, np.concatenate([found, edges[p]], axis=1), alpha, degree)
            to, by = edges[p].ravel(), np.repeat(p, degree)
            ok = to >= 0
            to, by = to[ok], by[ok]
            pick = np.argsort(to, kind="stable")
            to, by = to[pick], by[pick]
            target, start, count = np.unique(to, return_index=True, return_counts=True)
            back = np.full((len(target), int(count.max()) if len(count) else 0), -1, np.int64)
            if len(target):
                back[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(start, count)] = by
                for at in range(0, len(target), batch):
                    t = target[at : at + batch]
                    edges[t] = prune(x, t, np.concatenate([edges[t], back[at : at + batch]], axis=1), alpha, degree)
    return edges, entry


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True) if v.size else np.ones((len(v), 1))
    v = v / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _graphs(t: pa.Table) -> pa.Table:
    v = _matrix(t.column("v"))
    edges, entry = build(_unit(v).astype(np.float32))
    return pa.table({"dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "n": pa.array([len(v)], pa.int32()), "entry": pa.array([entry.tolist()], pa.list_(pa.int64())), "v": pa.array([v.tobytes()], pa.binary()), "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()), "ids": pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))})


def _searched(k: int, beam: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                g = {c: batch.column(c)[at].as_py() for c in ("n", "entry", "v", "edges", "ids")}
                asked = batch.column("queries")[at].values
                v = np.frombuffer(g["v"]).reshape(g["n"], -1)
                edges = np.frombuffer(g["edges"], np.int32).reshape(g["n"], -1).astype(np.int64)
                q_ids, q = asked.field("vec_id").to_numpy(zero_copy_only=False), _matrix(asked.field("v"))
                units = _unit(v)
                found, _ = search(units.astype(np.float32), edges, np.array(g["entry"]), _unit(q).astype(np.float32), min(beam, max(1, g["n"])))
                exact = np.einsum("mkd,md->mk", v[found], q) / np.sqrt((v * v).sum(axis=1))[found] / np.sqrt((q * q).sum(axis=1))[:, None]
                rows = []
                for i, own in enumerate(q_ids.tolist()):
                    near = sorted((-float(s), x) for f, s in zip(found[i].tolist(), exact[i].tolist(), strict=True) if f >= 0 for x in g["ids"][f] if x != own)
                    rows += [(own, x, -s) for s, x in near[:k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The k nearest vectors found of each query by cosine: query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding. Vectors that are equal are one vertex with its k + 1 smallest
    ids (a larger id of equals can't be among the k nearest), so thousands of copies make no more edges
    than one. Vertices fall by hash into shards of about `shard`; each shard gets a graph, built in two
    passes of greedy searches and robust pruning, and every block of queries runs through every shard's
    graph; blocks are sent once to each of at most LANES groups of shards, by shuffle, never through the driver. score is the cosine in double precision; ties go to the smaller id; a query's own id is left out.

    Vectors that are null, empty, zero or have null or non-finite components take no part, nor do rows
    without id. Vectors meet only those of as many components. Repeated rows count once; if a query id
    has several vectors, the first by value asks. Other columns are ignored.
    """
    def usable(df):
        v = df.select(column(df, "vec_id", "long").alias("vec_id"), column(df, "embedding", "array<double>").alias("v"))
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    rows = usable(vectors).withColumn("h", F.xxhash64("v"))
    order = Window.partitionBy("dim", "h", "v").orderBy("vec_id")
    few = rows.select("dim", "h", "v", "vec_id").distinct().withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}")
    vertices = few.groupBy("dim", "h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").agg(F.approx_count_distinct("h")).collect()}  # a row for each length of vectors
    number = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, max(1, round(n / shard)))]) if sizes else F.lit(None).cast("map<int,int>")
    shards = F.coalesce(number[F.col("dim")], F.lit(1))
    kinds = "dim int, shard long, n int, entry array<long>, v binary, edges binary, ids array<array<long>>"
    graphs = vertices.withColumn("shard", F.pmod("h", shards)).select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInArrow(_graphs, kinds)
    lanes = F.least(shards, F.lit(LANES)).cast("long")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, -(-sum(r[1] for r in asked.groupBy("dim").count().collect()) // BLOCK))
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    # the plan knows the size of the queries before they are repeated, so without the hint the driver would gather and broadcast all repeats
    sent = asked.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1)))
    found = graphs.withColumn("lane", F.pmod("shard", lanes)).join(sent.hint("merge"), ["dim", "lane"]).select("n", "entry", "v", "edges", "ids", "queries").mapInArrow(_searched(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
