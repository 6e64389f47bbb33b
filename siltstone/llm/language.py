"""Language identification with bit-sliced Bloom filters over n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import column, first_of_each, mix, raw, seeds, small_batches, table

_U = np.uint64
GRAM = 5
_STEP = 1 << 19
#: Letters stay, lower-cased; other ASCII becomes a space; bytes of other characters stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of bytes of texts in a row, and the number of each text.

    A gram lies within one text and holds a letter or a byte of a character beyond ASCII at its middle.
    """
    base = int(offsets[0])
    folded = _FOLD[data[base : int(offsets[-1])]]
    lead = np.flatnonzero(folded[:-1] == 0xC3) + 1
    upper = lead[(folded[lead] >= 0x80) & (folded[lead] < 0x9F) & (folded[lead] != 0x97)]
    folded[upper] += 0x20
    n = len(folded) - GRAM + 1
    counts = np.zeros(len(offsets) - 1, np.int64)
    if n <= 0:
        return np.zeros(0, _U), counts
    h = np.zeros(n, _U)
    for k in range(GRAM):
        h |= folded[k : k + n].astype(_U) << _U(8 * k)
    ok = folded[GRAM // 2 : GRAM // 2 + n] != 32
    for e in (offsets[1:-1] - base).tolist():
        ok[max(0, e - GRAM + 1) : e] = False
    at = np.flatnonzero(ok)
    counts += np.bincount(np.searchsorted(offsets - base, at, side="right") - 1, minlength=len(counts))[: len(counts)]
    return mix(h[at]), counts


class Filters:
    """Bloom filters of all languages in one array: bit l of a slot is a bit of the filter of language l."""

    def __init__(self, names: list[str], samples: list[tuple[np.ndarray, np.ndarray]], slots: int, hashes: int, ratio: float):
        self.names, self.slots = names, slots
        self.salt = seeds(hashes, 600)
        planes = -(-max(1, len(names)) // 64)
        self.masks = [np.zeros(slots, _U) for _ in range(planes)]
        keys = [np.unique(h, return_counts=True) for h, _ in samples]
        all_, back = np.unique(np.concatenate([k for k, _ in keys] or [np.zeros(0, _U)]), return_inverse=True)
        most = np.zeros(len(all_))
        rates = [c / max(1, len(h)) for (_, c), (h, _) in zip(keys, samples, strict=True)]
        at = 0
        places = []
        for r in rates:
            places.append(back[at : at + len(r)])
            at += len(r)
            np.maximum.at(most, places[-1], r)
        for l, ((k, c), r, place) in enumerate(zip(keys, rates, places, strict=True)):
            own = k[(r >= ratio * most[place]) & (c > 1)]
            for x in self.where(own):
                np.bitwise_or.at(self.masks[l // 64], x, _U(1 << (l % 64)))
        self.masks = [m.astype(np.uint8) if len(names) <= 8 else m for m in self.masks]
        bit = [(self.masks[l // 64] >> self.masks[l // 64].dtype.type(l % 64)) & self.masks[l // 64].dtype.type(1) for l in range(len(names))]
        self.false = [float(b.mean()) ** hashes for b in bit]

    def where(self, h: np.ndarray) -> list[np.ndarray]:
        return [(mix(h ^ s) % _U(self.slots)).astype(np.int64) for s in self.salt]

    def held(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, languages): how many grams of a text the filter of each language holds."""
        out = np.zeros((len(counts), len(self.names)))
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        places, starts = self.where(h), (np.cumsum(counts) - counts)[some]
        for p, m in enumerate(self.masks):
            found = m[places[0]]
            for x in places[1:]:
                found &= m[x]
            for l in range(64 * p, min(64 * p + 64, len(self.names))):
                bits = (found >> m.dtype.type(l % 64)) & m.dtype.type(1)
                out[some, l] = np.add.reduceat(bits.astype(np.int64), starts)
        return out

    def corrected(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts less those that are held falsely, 0 at least."""
        false = np.array(self.false)
        return np.maximum(0, (held - counts[:, None] * false) / np.maximum(1e-9, 1 - false))


def _long_steps(offsets: np.ndarray) -> list[tuple[int, int]]:
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1))
        out.append((lo, hi))
        lo = hi
    return out


def _scores(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if offsets[-1] - offsets[0] <= 2 * _STEP:
        h, counts = grams(data, offsets)
        return filters.corrected(filters.held(h, counts), counts)
    held, total = np.zeros((1, len(filters.names))), np.zeros(1)
    # one very long text: raw counts of parts that overlap by a gram, corrected once
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + _STEP, end)
        while stop < end and data[stop] & 0xC0 == 0x80:  # a part begins with a whole character
            stop -= 1
        h, counts = grams(data, np.array([at, min(stop + GRAM - 1, end)]))
        held += filters.held(h, counts)
        total += counts
        at = stop
    return filters.corrected(held, total)


def _predicted(filters):
    f = filters.value

    def run(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()
            data, offsets = raw(batch.column("text"))
            texts = batch.column("text")
            names, scores = [], []
            for lo, hi in _long_steps(offsets):
                s = _scores(f, data, offsets[lo : hi + 1]) if f.names else np.zeros((hi - lo, 0))
                part = data[offsets[lo] : offsets[hi]]
                letter = np.append(((part | 32) >= 97) & ((part | 32) <= 122), False).astype(np.int64)
                beyond = np.append(part >= 128, False).astype(np.int64)
                starts = offsets[lo:hi] - offsets[lo]
                filled = np.diff(offsets[lo : hi + 1]) > 0
                ascii_, other = (np.where(filled, np.add.reduceat(x, starts), 0) for x in (letter, beyond))
                for i in range(hi - lo):
                    some = ascii_[i] > 0 or other[i] > 0 and any(c.isalpha() for c in texts[lo + i].as_py())
                    if not some or not f.names:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best, total = int(s[i].argmax()), float(s[i].sum())
                    names.append(f.names[best])
                    scores.append(float(s[i, best]) / total if total > 0 else 0.0)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def fit(docs: DataFrame, sample: int = 400, slots: int = 1 << 20, hashes: int = 2, ratio: float = 0.2) -> Filters:
    """Filters from at most `sample` documents of each language: those first by a hash of doc_id.

    Only rows with text, lang and a doc_id whose crc32 as text leaves a remainder other than 2 on
    division by 4 take part; of rows that repeat doc_id and lang, the smallest text. A gram enters the filter of a language if it occurs there at least twice and
    at a rate of at least `ratio` times the largest of any language.
    """
    kinds = {"doc_id": "long", "text": "string", "lang": "string"}
    docs = docs.select(*[column(docs, c, k).alias(c) for c, k in kinds.items()])
    rows = docs.where("text is not null and lang is not null and crc32(cast(doc_id as string)) % 4 != 2")
    chosen = first_of_each(rows.select("doc_id", "lang").distinct(), "lang", sample, [F.xxhash64("doc_id"), F.col("doc_id")])
    rows = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most `sample` ids a language
    got = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").select("lang", "text").toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    samples = []
    for name in names:
        texts = got.filter(pa.compute.equal(got.column("lang"), name)).column("text")
        data, offsets = raw(texts)
        parts = [grams(data, offsets[lo : hi + 1]) for lo, hi in _long_steps(offsets)]
        h = np.concatenate([p for p, _ in parts])
        samples.append((np.sort(h), np.array([len(h)])))
    return Filters(names, samples, slots, hashes, ratio)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of docs but text, with lang_pred and score (columns of these names are replaced).

    Each n-gram of a text is looked up once, which gives the bitmask of all languages that hold it;
    the popcount of each language, corrected for its filter's false positives, decides, ties to the
    name that sorts first. score is the winner's share of all corrected counts, 0 to 1. A null text,
    one without a letter, and any text if nothing was learned, is `und` with score 0. Repeated rows and
    rows with null doc_id are predicted like others.
    """
    docs = docs.drop("lang_pred", "score")
    docs = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # slots x 1 to 8 bytes for each 64 languages
    return docs.mapInArrow(lambda batches: _predicted(sent)(batches), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (never learned from), lang_pred and score of every row of documents; see identify().

    A null text, or one without letters, is `und` with score 0; a null doc_id isn't held out; repeated rows each come back.
    """
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
