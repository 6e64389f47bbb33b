"""Document fingerprints: a digest of quartiles of counts of hashed byte triplets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import column, seeds, small_batches, table

BUCKETS = 128
#: A difference of this much or more is a likeness of 0.
FAR = 300
_TABLE = (seeds(3 * 256, 4000) >> np.uint64(57)).astype(np.uint8).reshape(3, 256)
_PAIRS = ((1, 2), (1, 3), (2, 3))
_STEP = 1 << 20


def _counts(data: np.ndarray) -> np.ndarray:
    """Counts of the triplets (0,1,2), (0,1,3), (0,2,3) of each window of four bytes, by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), _STEP):
        part = data[at : at + _STEP + 3]
        n = len(part) - 3
        if n <= 0:
            break
        a, b, c = (t[part] for t in _TABLE)
        for salt, (i, j) in enumerate(_PAIRS):
            x = a[:n] ^ b[i : i + n] ^ c[j : j + n]
            out += np.bincount(x ^ np.uint8(41 * salt), minlength=BUCKETS)
    return out


def fingerprint(text: bytes) -> str:
    """Length (2 hex digits), both quartile ratios (1 each), then 2 bits for each bucket in hex.

    The length is on a logarithmic scale. A bucket's bits say which quartile of all buckets' counts
    it lies in. Empty texts and those under four bytes have no triplets: all buckets are 0.
    """
    c = _counts(np.frombuffer(text, np.uint8))
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    bits = (c > q1).astype(np.int64) + (c > q2) + (c > q3)
    size = min(255, int(np.log(max(1, len(text))) / np.log(1.08)))
    r1, r2 = (int(100 * q / q3) % 16 if q3 else 0 for q in (q1, q2))
    body = "".join(f"{int(x):x}" for x in bits.reshape(-1, 2) @ (4, 1))
    return f"{size:02x}{r1:x}{r2:x}{body}"


def _ring(a: int, b: int, n: int) -> int:
    return min((a - b) % n, (b - a) % n)


def difference(a: str, b: str) -> int:
    """Distance of two fingerprints: lengths and ratios weigh 12 beyond a step, opposite quartiles 6."""
    size = abs(int(a[:2], 16) - int(b[:2], 16))
    out = size if size <= 1 else 12 * min(size, 10)
    for i in (2, 3):
        d = _ring(int(a[i], 16), int(b[i], 16), 16)
        out += d if d <= 1 else 12 * (d - 1)
    x, y = (np.array([int(v, 16) for v in s[4:]]) for s in (a, b))
    steps = np.abs(np.concatenate([x >> 2, x & 3]) - np.concatenate([y >> 2, y & 3]))
    return out + int(np.where(steps == 3, 6, steps).sum())


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints down to 0 for a difference of FAR or more."""
    return 1 - min(difference(a, b), FAR) / FAR


def _followed(batches):
    """For rows sorted by (part, doc_id descending): each row with the text after it.

    A row marked `ahead` is the first one of the next part: it only ends its part.
    """
    held = None

    def out(row, after, next_):
        doc_id, text, own = row
        n = len(text)
        half = n // 2
        edited = (text[: n - half] + after[:half]).encode()
        other = fingerprint(edited)
        return doc_id, n, hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, next_)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = []
            for part, ahead, doc_id, text in zip(*(batch.slice(at, 1000).column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
                print_ = fingerprint(text.encode())  # once as a text's own and as the next one's
                if held and held[0] == part:
                    rows.append(out(held[1], text, print_))
                held = None if ahead else (part, (doc_id, text, print_))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def _spread(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers of which each falls into a partition of its own when dealt to n partitions by hash."""
    known: dict[int, int] = {}
    at, size = 0, 16 * n
    while len(known) < n:
        dealt = spark.range(at, at + size).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        for k, p in dealt.groupBy("p").agg(F.min("k")).select(F.col("min(k)"), "p").collect():  # n rows
            known.setdefault(p, k)
        at += size
    return np.array([known[p] for p in range(n)], np.int32)


def fingerprints(docs: DataFrame, parts: int = 0) -> DataFrame:
    """Fingerprints of each text and of its edited text, which ends like the next document begins.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The order is doc_id descending, null last, ties by text; after the last row comes the first, so a
    row alone follows itself. Null text: empty. Equal texts have equal fingerprints.

    Each document moves once, to the range of ids that it lies in; the first document of each range
    goes to the range before it too, so each range works alone. Bounds of ranges are quantiles of the
    ids: `parts` numbers (0: one for each 16 MB or so of input partitions) are all the driver holds.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    parts = parts or max(8, ids.rdd.getNumPartitions())
    bounds = ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = np.array(sorted({-int(b) for b in bounds}), np.int64)

    names = _spread(docs.sparkSession, len(bounds) + 2)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(names[np.searchsorted(bounds, -doc_id.to_numpy(np.int64), side="right")], dtype="int32")

    part = F.when(F.col("doc_id").isNull(), F.lit(int(names[-1]))).otherwise(range_of(F.coalesce("doc_id", F.lit(0))))
    place = {int(name): i for i, name in enumerate(names)}
    found = ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("first")).collect()  # a row for each part
    firsts = sorted(((r[0], r[1]) for r in found), key=lambda r: place[r[0]])
    marked = docs.withColumn("part", part)
    if not firsts:
        return docs.limit(0).mapInArrow(lambda b: iter(()), _SCHEMA)
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    spark = docs.sparkSession
    link = F.broadcast(spark.createDataFrame([(p, f, before[p]) for p, f in firsts], "p int, first long, earlier int"))
    copies = marked.join(link, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("earlier").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text")
    copies = copies.groupBy("part", "ahead", "doc_id").agg(F.min("text").alias("text"))
    rows = marked.select("part", F.lit(False).alias("ahead"), "doc_id", "text").unionByName(copies)
    dealt = rows.repartition(len(names), "part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_followed, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of documents; see fingerprints(). Nulls are empty texts, repeated rows each come back."""
    return fingerprints(table(spark, sf_dir, "documents"))
