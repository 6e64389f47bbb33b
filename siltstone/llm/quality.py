"""Document quality: a linear-chain conditional random field labels lines, marginals make the score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import _SPACE, _words_of, column, first_of_each, raw, small_batches, table

_STEP = 1 << 20
THRESHOLD = 0.3
#: Kinds of bytes: upper case, lower case, digit, space, byte beyond ASCII, bar, mark, other sign.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_CLASS[list(b" \t\r\x0b\x0c")] = 3
_CLASS[ord("|")] = 5
_CLASS[list(b"!?#$%&*@^~<>{}=_")] = 6
_CLASS[10] = 3


def _line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, features) of lines that lie in data; all are means over a line's bytes or words."""
    n, size = len(starts), np.maximum(1, ends - starts)
    out = []
    row = np.repeat(np.arange(n), ends - starts)
    at = np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(len(row))
    text = data[at]
    kinds = np.bincount(row * 8 + _CLASS[text], minlength=8 * n).reshape(n, 8)
    out += [kinds[:, k] / size for k in range(8)]
    h, s = _words_of(text, np.cumsum(ends - starts) - (ends - starts)) if len(text) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    r = row[s] if len(s) else np.zeros(0, np.int64)
    words = np.maximum(1, np.bincount(r, minlength=n))
    out.append(np.minimum(3, size / words / 8))
    order = np.lexsort((h, r))
    same = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
    out.append(np.bincount(r[order][1:][same], minlength=n) / words)
    for lag in (1, 2, 3):
        again = (h[lag:] == h[:-lag]) & (r[lag:] == r[:-lag]) if len(h) > lag else np.zeros(0, bool)
        out.append(np.bincount(r[lag:][again] if len(again) else r[:0], minlength=n) / words)
    last = np.append(_SPACE[text[1:]], True) | (np.append(row[1:] != row[:-1], True)) if len(text) else np.zeros(0, bool)
    mark = last & np.isin(_CLASS[text], (6, 7)) & ~np.isin(text, list(b".,;:"))
    out.append(np.minimum(1, np.bincount(row[mark], minlength=n) / words))
    out += [words <= 3, np.minimum(1, np.log1p(words) / 7), (ends - starts) == 0]
    return np.stack([np.asarray(x, float) for x in out], axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts in a row with those of the lines before and after; lines of each
    text; bytes of each line. Every text has a line at least."""
    base, n = int(offsets[0]), len(offsets) - 1
    part = data[base : int(offsets[-1])]
    breaks = np.flatnonzero(part == 10)
    starts = np.concatenate([offsets[:-1] - base, breaks + 1])
    # a newline that ends a text starts an empty line of that text, not one of the next
    text = np.concatenate([np.arange(n), np.searchsorted(offsets[1:] - base, breaks, side="right")])
    pick = np.lexsort((starts, text))
    starts, text = starts[pick], text[pick]
    follows = np.append(text[1:] == text[:-1], False)
    ends = np.where(follows, np.append(starts[1:], 0) - 1, (offsets[1:] - base)[text])
    ends = np.maximum(ends, starts)
    x = _line_features(part, starts, ends)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][follows[:-1]] = x[:-1][follows[:-1]]
    after[:-1][follows[:-1]] = x[1:][follows[:-1]]
    x = np.concatenate([x, x * x, before, after, np.ones((len(x), 1))], axis=1)
    return x, np.bincount(text, minlength=n), ends - starts


def _chains(u: np.ndarray, counts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of label 1 for chains of lines in a row; t: transitions (2, 2)."""
    step = lambda a, m: np.logaddexp(a + m[1, 1], m[0, 1]) - np.logaddexp(a + m[1, 0], m[0, 0])
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(1, (counts.max() if len(counts) else 0) + 1), side="right")
    f, b = u.copy(), np.zeros_like(u)
    for k in range(1, len(active)):
        i = first[order[: active[k]]] + k
        f[i] += step(f[i - 1], t)
    for k in range(1, len(active)):
        i = (first + counts)[order[: active[k]]] - 1 - k
        b[i] = step(u[i + 1] + b[i + 1], t.T)
    return f, b


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


class Field:
    """Weights of the field and of the step from line marginals to the document's score."""

    def __init__(self, width: int):
        self.w, self.t = np.zeros(width), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.a, self.b = 1.0, 0.0

    def line_odds(self, x, counts):
        f, b = _chains(((x - self.mean) / self.scale) @ self.w, counts, self.t)
        return f + b

    def good(self, x, counts, size) -> np.ndarray:
        """The share of each text, by length, that is good by its lines' marginals; at least a byte a line."""
        p = _sigmoid(self.line_odds(x, counts))
        weight, row = np.maximum(1, size), np.repeat(np.arange(len(counts)), counts)
        return np.bincount(row, p * weight, minlength=len(counts)) / np.bincount(row, weight, minlength=len(counts))

    def scores(self, data, offsets) -> np.ndarray:
        x, counts, size = features(data, offsets)
        return _sigmoid(self.a * (self.good(x, counts, size) - 0.5) + self.b)

    def learn(self, x, counts, size, label, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Likelihood ascent (Adam) with the label of a document at its lines, then again with lines of
        bad documents that look good labelled good; then one logistic step for the documents."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        z = (x - self.mean) / self.scale
        row = np.repeat(np.arange(len(counts)), counts)
        share = 0.5 / np.maximum(1, np.bincount(label, minlength=2))[label]
        weight = (share / counts)[row]
        y = label[row].astype(float)
        pair = np.flatnonzero(row[1:] == row[:-1])
        for again in range(2):
            if again:
                likely = _sigmoid(z @ self.w) > 0.9
                y = np.where((label[row] == 0) & likely, 1.0, label[row])
            m1, m2 = [np.zeros_like(self.w), np.zeros((2, 2))], [np.zeros_like(self.w), np.zeros((2, 2))]
            for k in range(1, rounds + 1):
                u = z @ self.w
                f, b = _chains(u, counts, self.t)
                p = _sigmoid(f + b)
                g = [z.T @ ((y - p) * weight) - decay * self.w, -decay * self.t]
                a, c = f[pair], (u + b)[pair + 1]
                joint = np.stack([self.t[i, j] + i * a + j * c for i in (0, 1) for j in (0, 1)])
                joint = np.exp(joint - joint.max(axis=0))
                joint /= joint.sum(axis=0)
                seen = np.stack([(y[pair] == i) & (y[pair + 1] == j) for i in (0, 1) for j in (0, 1)])
                g[1] = g[1] + ((seen - joint) @ weight[pair]).reshape(2, 2)
                for q, (param, grad) in enumerate(zip((self.w, self.t), g, strict=True)):
                    m1[q] = 0.9 * m1[q] + 0.1 * grad
                    m2[q] = 0.99 * m2[q] + 0.01 * grad**2
                    param += rate * (m1[q] / (1 - 0.9**k)) / (np.sqrt(m2[q] / (1 - 0.99**k)) + 1e-9)
        good = self.good(x, counts, size) - 0.5
        for _ in range(500):
            e = label - _sigmoid(self.a * good + self.b)
            self.a += 5 * float((e * good).mean()) - 1e-4 * self.a
            self.b += 5 * float(e.mean())


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> Field:
    """A field from at most `sample` documents of each quality, those first by a hash of doc_id.

    Only labels of rows whose crc32 of doc_id, as text, isn't divisible by 5 take part. A document with
    several labels counts with the smallest, one with several texts with the smallest text. Without documents of both labels, all scores are equal.
    """
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "quality", "int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = first_of_each(known, "quality", sample, [F.xxhash64("doc_id"), F.col("doc_id")])
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toArrow()  # at most `sample` ids for each of two labels
    got = got.sort_by([("doc_id", "ascending")])
    data, offsets = raw(got.column("text"))
    x, counts, size = features(data, offsets)
    field = Field(x.shape[1])
    label = np.array(got.column("quality").to_pylist(), np.int64)
    if len(label) and 0 < label.mean() < 1:
        field.learn(x, counts, size, label)
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row of docs.

    Lines are what newlines separate; a null or empty text is one empty line and gets a score like any
    other. Repeated rows and null doc_ids are scored like others; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            out, lo, n = [np.zeros(0)], 0, len(offsets) - 1
            while lo < n:
                hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1))
                out.append(sent.value.scores(data, offsets[lo : hi + 1]))
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (never learned from), score and predicted of every row of documents; see score().

    Null and empty texts are scored too; a null doc_id isn't held out; repeated rows each come back.
    """
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
