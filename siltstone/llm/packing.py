"""Best-fit packing of tokenised documents by linear grouping and configurations of few sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import ids_of
from ._base import column, cut, ranks, raw, table

CAPACITY = 2048

def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        known = ids_of(path)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), known.of_batch(*raw(part.column("text"))), strict=True):
                    ids += b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(x) // 4, zlib.crc32(x), x if with_ids else None))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows), kinds, names)], names)

    return run


# The plan: which lengths lie together. It is made from the counts of each length alone.


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Fractional numbers of configurations that cover the demand with the fewest bins.

    Column generation: a dense simplex over one column for each size, priced by a knapsack.
    """
    k = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    cost = np.ones(k)
    inverse = np.diag([1 / (capacity // x) for x in sizes])
    x = inverse @ d
    most = capacity // min(sizes)
    for _ in range(40 * k):
        y = cost @ inverse
        low = int(np.argmin(y))
        if y[low] < -1e-9:
            new, price = -np.eye(k)[low], 0.0
        else:
            new, price = _knapsack(s, y, capacity, most), 1.0
            if new @ y <= 1 + 1e-7:
                break
        w = inverse @ new
        ratio = np.where(w > 1e-11, x / np.where(w > 1e-11, w, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * w
        x[out] = ratio[out]
        row = inverse[out] / w[out]
        inverse = inverse - np.outer(w, row)
        inverse[out] = row
        columns[out], cost[out] = new, price
    return [([int(v) for v in c], float(n)) for c, n, p in zip(columns, x, cost, strict=True) if p and n > 1e-9]


def _knapsack(s: np.ndarray, y: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The multiset of sizes within the capacity with the largest sum of y."""
    best = np.zeros(capacity + 1)
    picks = []
    index = np.arange(capacity + 1)[None, :] - s[:, None]
    for _ in range(most):
        gain = np.where(index >= 0, best[np.maximum(index, 0)] + y[:, None], -1.0)
        pick = gain.argmax(axis=0)
        value = gain[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        picks.append(np.where(better, pick, -1))
        if not better.any():
            break
        best = np.where(better, value, best)
    out, at = np.zeros(len(s)), capacity
    for layer in reversed(picks):
        if layer[at] >= 0:
            out[layer[at]] += 1
            at -= int(s[layer[at]])
    return out


def plan(counts: dict[int, int], capacity: int, parts: tuple[int, ...], groups: int) -> list:
    """The plan with the fewest bins over the bounds capacity / parts between small and large."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best: list = []
    for p in parts:
        now = grouped(counts, capacity, capacity // p, groups)
        if not best or sum(n for _, n in now) < sum(n for _, n in best):
            best = now
        if sum(n for _, n in best) <= least:
            break
    return best


def grouped(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as (((length, copies), ...), number of such bins), from the count of each length."""
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    if capacity in left:
        bins.append((((capacity, 1),), left.pop(capacity)))
    large = sorted((n for n in left if n > small), reverse=True)
    if large:
        total = sum(left[n] for n in large)
        each = -(-total // groups)
        runs: list[list[list[int]]] = [[]]
        room = each
        for n in large:  # equal-cardinality groups of descending lengths
            c = left.pop(n)
            while c:
                if not room:
                    runs.append([])
                    room = each
                take = min(c, room)
                runs[-1].append([n, take])
                c, room = c - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for r in runs:  # groups that round to one size are one
            merged.setdefault(r[0][0], []).extend(r)
        sizes = list(merged)
        runs = [merged[n] for n in sizes]
        solved = configurations(sizes, [sum(c for _, c in r) for r in runs], capacity)
        for config, number in solved:
            bins += _substituted(config, int(number + 1e-6), runs)
        for r in runs:
            for n, c in r:
                if c:
                    left[n] = left.get(n, 0) + c
    return _best_fit(bins, left, capacity)


def _substituted(config: list[int], number: int, runs: list[list[list[int]]]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """`number` bins of a configuration, with actual lengths in the place of rounded ones."""
    out = []
    while number > 0:
        n, chosen = number, []
        for g, copies in enumerate(config):
            while runs[g] and not runs[g][0][1]:
                runs[g].pop(0)
            if copies and runs[g]:
                n = min(n, max(1, runs[g][0][1] // copies))
        for g, copies in enumerate(config):
            for run in runs[g]:
                if not copies:
                    break
                k = min(copies, run[1] // n) if run[1] >= n else 0
                if k:
                    chosen.append((run[0], k))
                    run[1] -= k * n
                    copies -= k
                if n > 1:
                    break
        if not chosen:
            break
        out.append((tuple(chosen), n))
        number -= n
    return out


def _best_fit(bins, left: dict[int, int], capacity: int):
    room: dict[int, list] = defaultdict(list)
    for content, n in bins:
        room[capacity - sum(x * k for x, k in content)].append((content, n))
    order = sorted(room)
    for length in sorted(left, reverse=True):
        c = left[length]
        while c:
            i = bisect_left(order, length)
            if i == len(order):
                room[capacity].append(((), max(1, c)))
                insort(order, capacity)
                continue
            r = order[i]
            content, n = room[r].pop()
            if not room[r]:
                del room[r], order[i]
            fit = r // length
            full = min(n, c // fit)
            parts = [(fit, full), (c % fit, 1)] if full < n and c // fit == full and c % fit else [(fit, full)]
            used = 0
            for k, m in parts:
                if m:
                    used += m
                    c -= k * m
                    _put(room, order, r - k * length, (*content, (length, k)), m)
            if used < n:
                if content or r < capacity:
                    _put(room, order, r, content, n - used)
    return [x for r in sorted(room) for x in room[r] if x[0]]


def _put(room, order, r, content, n) -> None:
    if r not in room:
        insort(order, r)
    room[r].append((content, n))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, parts: tuple[int, ...] = (2, 3, 4, 6, 8), groups: int = 32, with_ids: bool = False) -> DataFrame:
    """Packs tokenised documents (ids, then an id 0) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the ids
    (binary, little-endian unsigned 32-bit).

    Only the number of pieces of each length (at most `capacity` rows) goes to the driver, which makes
    the plan, the best over the values of `parts`. Pieces longer than capacity / parts are large: in descending order they form `groups`
    groups of equal cardinality, each rounded up to its longest; a linear program over configurations
    of these few sizes, rounded down, gives bins; actual lengths take the places of rounded ones. What is
    over, and all small pieces, go best-fit, longest first, where the least room is left. Each piece
    then finds its place by its rank among the pieces of its length, which partitions count on their
    own (see ranks()), so no length is gathered in a task.

    Null or empty text: one piece, the id 0. Repeated rows and null doc_ids are documents like others.
    No documents: no sequences. Other columns of docs are ignored.
    """
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    placed = ranks(docs.mapInArrow(_pieces(tokenizer, capacity, with_ids), kinds), ["length"])
    placed = cut(placed)
    counts = {r[0]: r[1] for r in placed.groupBy("length").agg(F.max("before") + 1).collect()}
    rows, first = [], 0
    used: dict[int, int] = defaultdict(int)
    for content, n in plan(counts, capacity, parts, groups):
        base = 0
        for length, k in content:
            rows.append((length, used[length], first, k, base))
            used[length] += k * n
            base += k * length
        first += n
    rows.sort()
    return placed.mapInArrow(_places(rows), kinds + ", sequence_id long, offset long")


def _places(rows: list[tuple[int, int, int, int, int]]):
    p = np.array(rows, np.int64).reshape(-1, 5)

    def run(batches):
        key = p[:, 0] * (1 << 48) + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "before"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            j = rank - p[at, 1]
            k = p[at, 3]
            names = [n for n in batch.schema.names if n != "before"]
            extra = [pa.array(p[at, 2] + j // k), pa.array(p[at, 4] + j % k * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *extra], [*names, "sequence_id", "offset"])

    return run


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
