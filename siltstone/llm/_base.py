"""What the operators of this subpackage share: tables, lineage cuts, hashing and distributed ranks."""

from __future__ import annotations

import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: ASCII white space: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text, and texts, that one vectorised step works on.
STEP, STEP_ROWS = 1 << 20, 2048
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task hands to its Python worker at once: 1000 rows and 4 MB instead of Spark's 10000 and 64.

    Whole texts go in these batches, in the JVM's and in the worker's memory at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster names in spark.checkpoint.dir and goes on from there.

    Where that is unset, a temporary folder serves on a single machine (tests); a cluster must name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files and checkpoints of steps that nothing refers to any more.

    It drops them when the driver's JVM has collected the objects that stand for them; a driver with little to do
    collects seldom, so the files of all steps lie on the executors' disks together.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that df doesn't hold (in any case): _name, or with more underscores before it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column by name, as the given type; a null literal where df has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def ranks(df: DataFrame, keys: list[str], size: str | None = None) -> DataFrame:
    """Adds `before`: the sum of `size` (or the number of rows) in rows of the same keys that come earlier.

    "Earlier" is the order of partitions and of rows in them, so df should come from cut() with the
    order that is wanted. A key is never gathered into one task: each partition sums its own rows, and
    only one row for each partition and key takes part in the sums across partitions.
    """
    df = cut(df.withColumn("_part", F.spark_partition_id()))
    amount = F.col(size) if size else F.lit(1)
    names = [f"_k{i}" for i in range(len(keys))]
    by = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    sums = df.groupBy("_part", *by).agg(F.sum(amount).cast("long").alias("_amount"))
    order = Window.partitionBy(*names).orderBy("_part")
    starts = sums.select(F.col("_part").alias("_of"), *names, (F.sum("_amount").over(order) - F.col("_amount")).alias("_start"))
    on = F.col("_part") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = _running(df, keys, size).join(starts, on)
    return joined.withColumn("before", F.col("_start") + F.col("_inside")).drop("_of", "_start", "_inside", "_part", *names)


def first_of_each(df: DataFrame, key: str, n: int, order: list) -> DataFrame:
    """At most n rows of each key, the first in the given order.

    First within 64 salts of a key, then within 8, then among what is left: a task sees a 64th of a key, and at most
    8 * n rows of it in the later steps.
    """
    salt = F.pmod(F.xxhash64(F.lit(7), *order), F.lit(64))
    for salts in (64, 8, 1):
        one = Window.partitionBy(key, F.pmod(salt, F.lit(salts))).orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(one)).where(f"_r <= {n}").drop("_r")
    return df


def _running(df: DataFrame, keys: list[str], size: str | None) -> DataFrame:
    """Adds `_inside`, the running sum for each key in the rows of a partition, in their order."""
    schema = StructType([*df.schema.fields, StructField("_inside", LongType())])

    def run(batches):
        so_far: dict = {}
        for batch in batches:
            values = [batch.column(k).to_pylist() for k in keys]
            amounts = batch.column(size).to_pylist() if size else [1] * batch.num_rows
            inside = []
            for *key, amount in zip(*values, amounts, strict=True):
                key = tuple(key)
                inside.append(so_far.get(key, 0))
                so_far[key] = inside[-1] + (amount or 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], [*batch.schema.names, "_inside"])

    return df.mapInArrow(run, schema)


# Hashing over whole batches of texts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), in place on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix((np.arange(n, dtype=_U) + _U(start)) * _U(0x9E3779B97F4A7C15))


def _lowered(bytes_: np.ndarray) -> np.ndarray:
    out = bytes_.copy()
    out[65:91] = bytes_[97:123]
    return out


_BYTES = _lowered(seeds(256, 1000))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        _powers[key] = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, STEP + 65536), base, _U)]), dtype=_U)
    return _powers[key]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data; begins: where texts begin, a word never goes across one."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    start[begins] = inside[begins]
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, _U), s
    terms = _BYTES[data]
    terms *= _power(_BASE, len(data))[: len(data)]
    terms[~inside] = 0
    h = np.add.reduceat(terms, s)
    h *= _power(_INVERSE, len(data))[s]
    return mix(h), s


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of texts in a row, and the number of words of each text."""
    n = len(offsets) - 1
    hashes, counts = [], np.zeros(n, np.int64)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + STEP, end)
        while stop < end and not _SPACE[data[stop]]:  # never within a word
            near = np.flatnonzero(_SPACE[data[stop : stop + 65536]])
            stop = stop + int(near[0]) if len(near) else min(stop + 65536, end)
        lo, hi = np.searchsorted(offsets, [at, stop], side="left")
        h, s = _words_of(data[at:stop], offsets[lo:hi] - at)
        rows = np.searchsorted(offsets, s + at, side="right") - 1
        counts += np.bincount(rows, minlength=n)[:n]
        hashes.append(h)
        at = stop
    return np.concatenate(hashes) if hashes else np.zeros(0, _U), counts


_PLACES = seeds(5, 77) | _U(1)


def shingles(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of texts in a row and the number of each text; repeats stay.

    A text with 1 to 4 words has one shingle, its whole sequence; one without words has none.
    """
    total = len(h)
    out = np.zeros(total, _U)
    if not total:
        return out, np.zeros(len(counts), np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(total)
    for k in range(5):
        part = np.zeros(total, _U)
        part[: max(0, total - k)] = h[k:]
        part *= _PLACES[k]
        part[at + k >= ends] = _U((1 + k) * 0xD6E8FEB86659FD93 % (1 << 64))
        out += part
        out = np.bitwise_xor(out, out >> _U(29))
    first = np.repeat(np.cumsum(counts) - counts, counts)
    keep = (at + 5 <= ends) | ((at == first) & (ends - first < 5))
    return mix(out)[keep], np.where(counts >= 5, counts - 4, np.minimum(counts, 1))


def steps(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of at most STEP_ROWS texts of about STEP bytes together (a longer text stands alone)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1)
        out.append((lo, min(hi, lo + STEP_ROWS, n)))
        lo = out[-1][1]
    return out


def sets(ids: pa.Array, col: pa.Array) -> list[np.ndarray]:
    """The sorted set of 5-word shingle hashes of each text; one that follows itself, by its id, is hashed once."""
    return sequences(ids, col, np.unique)


def sequences(ids: pa.Array, col: pa.Array, kept=lambda h: h) -> list[np.ndarray]:
    """What `kept` makes of the 5-word shingle hashes of each text; one that follows itself, by its id, is hashed once."""
    own = ids.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    data, offsets = raw(col.take(pa.array(first)))
    out = []
    for lo, hi in steps(offsets):
        h, counts = shingles(*words(data, offsets[lo : hi + 1]))
        ends = np.cumsum(counts)
        out += [kept(h[e - c : e]) for e, c in zip(ends, counts, strict=True)]
    return [out[i] for i in np.searchsorted(first, np.arange(len(own)), side="right") - 1]
