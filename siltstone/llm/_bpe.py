"""Token ids of texts, as the tokenizers library gives them, many texts at a time.

Texts of ASCII and Latin-1 letters (nearly all) are lower-cased and cut into words as arrays of bytes;
the new words of a batch are merged together, and a table keeps the ids of words by their hash. Any
other text, and one with an apostrophe or the beginning of a special token, is cut at spaces and
newlines, which the tokenizer drops; what is plain in it goes the same way, the rest to the library.
"""

from __future__ import annotations

import json
import re

import numpy as np

from ._base import _BASE, _INVERSE, _power, mix, seeds

#: Chunks and words that a worker remembers before it starts anew.
REMEMBERED = 600_000
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
_LONG = 48
#: Bytes of text in one step.
_STEP = 1 << 20
#: Kinds of bytes: 0 dropped, 1 letter, 2 digit, 3 sign, 4 not plain.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[32, 10]] = 0
_KIND[39] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERMS = seeds(256, 31337)


def _byte_names() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return [names[b] for b in range(256)]


class Ids:
    """Ids as little-endian unsigned 32-bit integers; for word-end BPE vocabularies with byte names."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.middle = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + end] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(keys)
        self._forget()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens around it."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.chunks) > REMEMBERED:
            self.chunks = {"": b""}
        known = self.chunks
        new = set().union(*split).difference(known) if split else set()
        if new:
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def _forget(self) -> None:
        self.pool = [np.zeros(0, np.uint32)]
        self.size = 0
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def of_batch(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each of the texts that lie in data, UTF-8, from one offset to the next."""
        out: list[bytes] = []
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1)
            out += self._of_step(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        return out

    def _of_step(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        low = _LOWER[data]
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < len(data)]
        second = data[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        sign = (second == 0x97) | (second == 0xB7)
        for kinds, mask in ((1, letter), (3, sign)):
            kind[lead[mask]] = kind[lead[mask] + 1] = kinds
        upper = lead[letter & (second < 0x9F)] + 1
        low[upper] += 0x20
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        kind[special] = 4
        odd = np.add.reduceat(np.append(kind == 4, False).astype(np.int64), np.minimum(offsets[:-1], len(data)))
        odd = (odd > 0) & (np.diff(offsets) > 0)
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins = offsets[:-1][np.diff(offsets) > 0]
        start[begins] = kind[begins] > 0
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(data))
        gaps = np.flatnonzero((kind == 0) & np.append(True, kind[:-1] > 0))  # a word ends at the next start or gap
        if len(gaps) and len(s):
            g = np.searchsorted(gaps, s)
            e = np.minimum(e, np.append(gaps, len(data))[g])
        ids, counts = self._words(low, s, e, kind)
        ends = np.append(0, np.cumsum(counts))
        cut = ends[np.searchsorted(s, offsets)] * 4
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        rows = np.flatnonzero(odd)
        for r, ids_ in zip(rows, self.of([bytes(data[offsets[r] : offsets[r + 1]]).decode() for r in rows]), strict=True):
            out[r] = ids_
        return out

    def _words(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words low[s:e], one after the other, and the number of each."""
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        terms = _TERMS[low]
        terms *= _power(_BASE, len(low))[: len(low)]
        terms[kind == 0] = 0
        h = np.add.reduceat(terms, s) * _power(_INVERSE, len(low))[s]
        h, first, back = np.unique(mix(h + (e - s).astype(np.uint64)), return_index=True, return_inverse=True)
        at, n = self._found(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.tables[0][0]) > REMEMBERED:
                self._forget()
                at, n = self._found(h)
                new = np.flatnonzero(at < 0)
            a, b = s[first[new]], e[first[new]]
            made, counts = self._merged_all(low, a, b)
            at[new] = self.size + np.cumsum(counts) - counts
            n[new] = counts
            self.pool.append(made)
            self.size += len(made)
            self._add(h[new], at[new], n[new])
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        at, n = at[back], n[back]
        total = int(n.sum())
        index = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)
        return self.pool[0][index], n

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for keys, where, counts in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[i] == h
                at[ok], n[ok] = where[i[ok]], counts[i[ok]]
        return at, n

    def _add(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        old, recent = self.tables
        recent = _sorted(recent, (h, at, n))
        if len(recent[0]) > 60_000:
            old, recent = _sorted(old, recent), tuple(x[:0] for x in recent)
        self.tables = [old, recent]

    def _merged_all(self, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = b - a
        counts, made = np.zeros(len(a), np.int64), {}
        short = np.flatnonzero(size <= _LONG)
        n = size[short]
        index = np.repeat(a[short] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids, c = self._merge(low[index], n)
        counts[short] = c
        long = np.flatnonzero(size > _LONG)
        if not len(long):
            return ids, counts
        texts = [bytes(low[a[i] : b[i]]).decode() for i in long]
        got = self._library(list(set(texts)))
        made = {i: np.frombuffer(got[t], "<u4") for i, t in zip(long.tolist(), texts, strict=True)}
        for i, x in made.items():
            counts[i] = len(x)
        parts = np.split(ids, np.cumsum(c)[:-1]) if len(c) else []
        made.update(zip(short.tolist(), parts, strict=True))
        return np.concatenate([made[i] for i in range(len(a))]), counts

    def _learn(self, new: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        plain = {c: _PARTS.findall(c.lower()) for c in new if _PLAIN.fullmatch(c) and "<|" not in c}
        fresh = list({w for parts in plain.values() for w in parts}.difference(self.words))
        short = [w for w in fresh if len(w) <= _LONG]
        self.words.update(zip(short, self._merged([w.encode() for w in short]), strict=True))
        self.words.update(self._library([w for w in fresh if len(w) > _LONG]))
        words = self.words.__getitem__
        for c, parts in plain.items():
            self.chunks[c] = b"".join(map(words, parts))
        self.chunks.update(self._library([c for c in new if c not in plain]))

    def _library(self, chunks: list[str]) -> dict[str, bytes]:
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True)}

    def _merged(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        ids, counts = self._merge(np.frombuffer(b"".join(words), np.uint8), lengths)
        data, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if words else []

    def _merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the first pair of the best rank in every word at once, until none is left anywhere."""
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        ids = self.middle[flat]
        final = np.cumsum(lengths) - 1
        ids[final] = self.last[flat[final]]
        row = np.repeat(np.arange(len(lengths)), lengths)
        rank, made = self._pairs(ids, row)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(ids)))
            least = np.repeat(best, size)
            over = least == self.none
            if over.any():
                done.append((row[over], ids[over]))
            hits = np.flatnonzero((rank == least) & ~over)
            if not len(hits):
                break
            hits = hits[np.append(True, row[hits][1:] != row[hits][:-1])]
            ids[hits] = made[hits]
            keep = ~over
            keep[hits + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[hits] = True
            ids, row, rank, made, changed = ids[keep], row[keep], rank[keep], made[keep], changed[keep]
            again = changed.copy()
            again[:-1] |= changed[1:]
            again = np.flatnonzero(again)
            rank[again], made[again] = self._ranked(ids, row, again)
        rows = np.concatenate([r for r, _ in done])
        values = np.concatenate([i for _, i in done])
        order = np.argsort(rows, kind="stable")
        return values[order].astype("<u4"), np.bincount(rows, minlength=len(lengths))

    def _pairs(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranked(ids, row, np.arange(len(ids)))

    def _ranked(self, ids: np.ndarray, row: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at some places; `none` where there is no merge."""
        after = np.minimum(where + 1, len(ids) - 1)
        key = (ids[where] << 20) | ids[after]
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        good = (self.keys[at] == key) & (row[where] == row[after]) & (after > where)
        return np.where(good, self.rank[at], self.none), self.made[at]


def _sorted(a: tuple, b: tuple) -> tuple:
    joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined)


_made: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The Ids of this worker: what it has learned serves all its tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _made:
        _made[path] = Ids(path)
    return _made[path]
