"""Mixing sources to target weights, in fixed-length blocks of tokens (words) drawn for output shards."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import WORD, column, cut, free, mix, ranks, seeds, small_batches, table

BLOCK = 512
SHARD = 4096
#: Sources up to which their list, a few numbers each, is broadcast; a longer one is joined by shuffles.
SOURCES_SENT = 10_000
_U = np.uint64


def targets(sizes: list[int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> list[float]:
    """Words wanted of each source: shares by weight (repeating) of all words, at most cap times its size.

    What a source can't take is shared by weight among the others, until none is above its limit.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(w[i] for i in sorted(free))
        over = {i for i in free if left * w[i] / total > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in sorted(over):
            out[i] = cap * sizes[i]
            left -= out[i]
        free -= over
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key: Feistel rounds, walked until within n."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.int64)).astype(_U)
    mask = (_U(1) << bits) - _U(1)
    x = index.astype(_U)
    todo = np.arange(len(x))
    while len(todo):
        b, m, k, v = bits[todo], mask[todo], key[todo], x[todo]
        for salt in _ROUNDS:
            left, right = v >> b, v & m
            v = (right << b) | (left ^ (mix(right + k + salt) & m))
        x[todo] = v
        todo = todo[v >= n[todo].astype(_U)]
    return x.astype(np.int64)


_ROUNDS = seeds(4, 800)


def _key(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return mix(source.astype(_U) * _U(0x9E3779B97F4A7C15) + epoch.astype(_U) + _U(seed * 0xD1B54A32D192ED03 % (1 << 64)))


def quota(index: int, size: int, words: int, block: int, seed: int) -> tuple[int, int, int, int]:
    """(blocks, whole epochs, whole slots of the last epoch, words of its last slot) that make `words`."""
    n = -(-size // block)
    if not n or not words:
        return n, 0, 0, 0
    epochs, rest = divmod(words, size)
    short = block * n - size
    where = _position(index, n, epochs, seed) if short else n
    slots = rest // block
    if slots > where or (slots == where and rest % block > block - short):
        slots = (rest + short) // block
        return n, epochs, slots, rest + short - slots * block
    return n, epochs, slots, rest % block


def _position(index: int, n: int, epoch: int, seed: int) -> int:
    """Where the permutation puts the last, short block."""
    bits = max(1, int(np.ceil(np.log2(max(n, 2)) / 2)))
    mask, key = (1 << bits) - 1, _key(np.array([index]), np.array([epoch]), seed)
    x = n - 1
    while True:
        for salt in reversed(_ROUNDS):
            right, left = x >> bits, x & mask
            f = int(mix(np.array([right], _U) + key + salt)[0]) & mask
            x = ((left ^ f) << bits) | right
        if x < n:
            return x


def _drawn(left: np.ndarray, size: int, seed: tuple[int, ...]) -> np.ndarray:
    """`size` slots drawn among sources by what each has left: a multinomial draw.

    Counts beyond what a source has left go to those with most left, so all slots are drawn in the end.
    """
    total = int(left.sum())
    if size >= total:
        return left.copy()
    counts = np.minimum(np.random.default_rng(seed).multinomial(size, left / total), left)
    for i in np.argsort(-(left - counts), kind="stable"):
        more = min(size - int(counts.sum()), int(left[i] - counts[i]))
        counts[i] += more
    return counts


def draws(slots: list[int], shard: int, seed: int, first: int, stop: int):
    """(shard, source, first slot, slots) for the shards from first to stop, by shard.

    Shards of `shard` slots are the leaves of a binary tree: at each node the slots of its first half are
    drawn from what the node has of each source, the other half has the rest. So any shard's counts follow from
    the draws on the way to it, and tasks make theirs without the others.
    """
    left = np.array(slots, np.int64)
    shards = -(-int(left.sum()) // shard)
    todo = [(0, shards, 1, np.zeros_like(left), left)]
    while todo:
        lo, hi, node, drawn, left = todo.pop()
        if hi <= first or lo >= stop or lo >= hi:
            continue
        if hi - lo == 1:
            yield from ((lo, int(i), int(drawn[i]), int(left[i])) for i in np.flatnonzero(left))
            continue
        mid = (lo + hi) // 2
        half = _drawn(left, (mid - lo) * shard, (seed, node))
        todo += [(mid, hi, 2 * node + 1, drawn + half, left - half), (lo, mid, 2 * node, drawn, half)]


class Mix:
    """A drawn mix: `places` (documents with their place in the stream of their source), `sources`, `uses`."""

    def __init__(self, docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, block: int = BLOCK, shard: int = SHARD, seed: int = 10):
        spark = docs.sparkSession
        small_batches(spark)
        text = column(docs, "text", "string")
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        rows = cut(docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "source", "string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie")))
        found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # the list of sources
        found = sorted(found, key=lambda r: (r[0] is None, r[0]))
        sizes = [r[1] for r in found]
        self.targets = targets(sizes, weights, cap)
        words = [min(int(cap * s), round(t)) for s, t in zip(sizes, self.targets, strict=True)]
        self.quotas = [quota(i, s, w, block, seed) for i, (s, w) in enumerate(zip(sizes, words, strict=True))]
        kinds = "source string, si int, source_size long, target double, blocks long, epochs long, whole long, rest long"
        data = [(r[0], i, r[1], t, *q) for i, (r, t, q) in enumerate(zip(found, self.targets, self.quotas, strict=True))]
        sources = spark.createDataFrame(data, kinds)
        self.sources = F.broadcast(sources) if len(data) <= SOURCES_SENT else sources
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["source", "doc_id", "tie"]
        self.places = cut(ranks(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), ["source"], "size"))
        self.places = self.places.join(self.sources, self.places.source.eqNullSafe(sources.source)).drop(sources.source)
        self.block, self.seed = block, seed
        self.shard = shard

    def plan(self) -> DataFrame:
        """(shard, si, first, n, blocks): the slots of each source that each shard draws."""
        slots, shard, seed = [n * e + w + (r > 0) for n, e, w, r in self.quotas], self.shard, self.seed
        blocks = np.array([q[0] for q in self.quotas], np.int64)

        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for at in np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1) if len(ids) else []:
                    rows = np.array(list(draws(slots, shard, seed, int(at[0]), int(at[-1]) + 1)), np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T), pa.array(blocks[rows[:, 1]])], ["shard", "si", "first", "n", "blocks"])

        return self.sources.sparkSession.range(-(-sum(slots) // shard)).mapInArrow(run, "shard long, si long, first long, n long, blocks long")

    def slots(self) -> DataFrame:
        """(shard, si, slot, epoch, block): every slot of every shard and the block that fills it."""
        seed = self.seed

        def run(batches):
            for batch in batches:
                si, slot, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("si", "slot", "blocks"))
                epoch = slot // n
                block = permuted(slot % n, n, _key(si, epoch, seed))
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("si"), batch.column("slot"), pa.array(epoch), pa.array(block)], ["shard", "si", "slot", "epoch", "block"])

        each = self.plan().select("shard", F.col("si").cast("int").alias("si"), "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
        return each.mapInArrow(run, "shard long, si int, slot long, epoch long, block long")

    def uses(self) -> DataFrame:
        """(si, block, full, part): how often a block is taken whole, and the words taken of it once more."""
        x = self.slots().join(self.sources.select("si", F.col("blocks").alias("n"), "epochs", "whole", "rest"), "si")
        last = (F.col("rest") > 0) & (F.col("slot") == F.col("n") * F.col("epochs") + F.col("whole"))
        return x.groupBy("si", "block").agg(F.sum(F.when(last, 0).otherwise(1)).alias("full"), F.sum(F.when(last, F.col("rest")).otherwise(0)).alias("part"))

    def overlaps(self) -> DataFrame:
        """Documents by the blocks that they lie in, joined with the uses of these blocks."""
        b = F.lit(self.block)
        end = F.col("before") + F.col("size")
        each = self.places.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / b), F.floor((end - 1) / b))))
        lo = F.greatest(F.col("before"), F.col("block") * b) - F.col("block") * b
        hi = F.least(end, (F.col("block") + 1) * b) - F.col("block") * b
        return each.withColumn("lo", lo).withColumn("hi", hi).join(self.uses().hint("merge"), ["si", "block"])  # grows with the data, never sent whole

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, and source."""
        words = F.col("full") * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo"))
        key = ["si", "doc_id", "before", "size", "tie"]
        took = self.overlaps().groupBy(*key).agg(F.sum(words).alias("taken"))
        all_ = took.unionByName(self.places.select(*key, F.lit(0).cast("long").alias("taken")))
        total = all_.where("size > 0").groupBy(*key).agg(F.sum("taken").alias("taken")).unionByName(all_.where("size = 0"))
        return total.join(self.sources, "si").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """What a mix of all sources takes of each document: doc_id, size, source_size, target, taken, source.

    The words of a source, by doc_id, form one stream, cut in blocks of `block` words. A source's target
    is met exactly, up to rounding: whole epochs of all its blocks, then slots of one more epoch,
    the last one cut short. Slots fall into output shards by multinomial draws; a slot's block is its
    place in a pseudorandom permutation of the blocks, new for each epoch; blocks and documents join by
    block index. No word is taken more than cap (3) times. Reruns agree.

    Null or empty text: size 0, taken 0. A null source is a source, the last one. Rows that repeat a
    doc_id, and null doc_ids, are documents of their own; their order is by a hash of the text.
    The list of sources with their sizes goes to the driver; nothing else does.
    """
    return Mix(docs, **options).documents()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: text as often as whole epochs take it, then the
    part that the last epoch takes, its stretches of words joined by newlines; n_chars follows.

    A document without words comes back once if its source is taken whole at least once.
    """
    m = Mix(docs, **options)
    key = ["doc_id", "tie", "source"]
    taken = F.when(F.col("full") > F.col("epochs"), F.col("hi")).otherwise(F.least("hi", "part"))
    spans = m.overlaps().withColumn("to", taken).where("to > lo")
    at = F.col("block") * F.lit(m.block) - F.col("before")
    spans = spans.groupBy(*key, "before").agg(F.sort_array(F.collect_list(F.struct((F.col("lo") + at).alias("a"), (F.col("to") + at).alias("b")))).alias("spans"))
    spans = spans.groupBy(*key).agg(F.collect_list("spans").alias("spans"))  # a list for each repeat of a row
    copies = m.places.groupBy(*key, "epochs").agg(F.count("*").alias("repeats"), F.max("size").alias("size"))
    on = lambda x, y: x.doc_id.eqNullSafe(y.doc_id) & x.tie.eqNullSafe(y.tie) & x.source.eqNullSafe(y.source)
    both = copies.join(spans, on(copies, spans), "left").select(copies.doc_id, copies.tie, copies.source, "epochs", "repeats", "size", "spans")
    # columns of docs go by number, so no name clashes with an own one
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.withColumns(dict(zip(free(docs, "doc_id", "source", "tie"), (column(docs, "doc_id", "long"), column(docs, "source", "string"), F.xxhash64(column(docs, "text", "string"))), strict=True)))
    once = own.toDF(*names, "doc_id", "source", "tie").dropDuplicates(["doc_id", "source", "tie"])
    rows = once.join(both, on(once, both)).select(*names, "epochs", "repeats", "size", "spans")
    schema = docs.schema
    text_of = names[docs.columns.index("text")] if "text" in docs.columns else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pick, texts = [], []
                values = [part.column(c).to_pylist() if c else [None] * part.num_rows for c in (text_of, "epochs", "repeats", "size", "spans")]
                for i, (text, epochs, repeats, size, spans) in enumerate(zip(*values, strict=True)):
                    whole = (epochs if size else min(epochs, 1)) * repeats
                    pick += [i] * whole
                    texts += [text] * whole
                    for each in spans or []:
                        pick.append(i)
                        texts.append(_stretches(text, [(s["a"], s["b"]) for s in each]))
                take = part.take(pa.array(pick, pa.int64()))
                out = []
                for name, f in zip(names, schema.fields, strict=True):
                    col = take.column(name)
                    if f.name == "text":
                        col = pa.array(texts, pa.string())
                    elif f.name == "n_chars":
                        col = pa.array([None if t is None else len(t) for t in texts]).cast(col.type)
                    out.append(col)
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _stretches(text: str, spans: list[tuple[int, int]]) -> str:
    """The text of stretches of words (from, to); those that touch are one."""
    ends = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in joined)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row of documents; see mix_sources().

    Null texts have size and taken 0; a null source is one, the last; repeated rows are documents of their own.
    """
    return mix_sources(table(spark, sf_dir, "documents"))
