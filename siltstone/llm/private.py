"""Personal data in texts: fixed patterns, and further spans by a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import column, small_batches, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a match never starts within a run of digits unless one ended there, and none ends within one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in order of start, then of KINDS."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the run of local characters before the sign, not before the last match's end
        lo = at
        while lo > done and not _NOT_LOCAL.match(text, lo - 1):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, "email", m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if any(c in text for c in "0123456789"):
        out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _only_digits(m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# The field. Labels: 0 is "nothing" (one word long), 1 to 4 are KINDS.

#: Words of the longest segment of each label.
LONGEST = (1, 9, 7, 6, 5)
_TOKEN = re.compile(r"\S+")
#: Words on each side of a sign that a segment with the sign may reach.
REACH = max(LONGEST) - 1
_EDGE = ".,;:!?\"'"
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|(?<!\S)at(?!\S)", re.I)
_DOT = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9]|[\[({<]\s?(?:dot|\.)\s?[\])}>]|(?<!\S)dot(?!\S)", re.I)


def _spelt(line: str) -> list[tuple[int, int]]:
    """(sign, end) of each sign for "at" with a dot behind it that a segment can hold too."""
    dots = [m.span() for m in _DOT.finditer(line)]
    out = []
    for m in _AT.finditer(line) if dots else ():
        after = next((d for d in dots if d[1] > m.end()), None)
        if after and len(line[m.end() : after[0]].split()) <= REACH:
            out.append((m.start(), after[1]))
    return out


def zones(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The words (start, end) that segments of some kind can hold, in lists that no such segment crosses.

    A segment of a kind lies in a line, holds no text of the spans in `taken` and has a sign: a digit, or for
    addresses an "at" before a dot, in any spelling. It is at most LONGEST words long, so words farther
    than REACH from every sign can only be "nothing": the field over all words of the text has the same best
    segmentation and the same probabilities as these lists have by themselves.
    """
    out: list[list[tuple[int, int]]] = []
    signed = {m.start() for m in _DIGIT.finditer(text)} if _DIGIT.search(text) else set()
    spelt = _DOT.search(text) is not None and _AT.search(text) is not None
    if not signed and not spelt:
        return out
    begin = 0
    for line in text.split("\n"):
        end = begin + len(line)
        inside = [t for t in taken if t[0] < end and t[1] > begin] if taken else []
        bounds = [begin, *(x for t in inside for x in t), end]
        for lo, hi in zip(bounds[::2], bounds[1::2], strict=True):
            part = text[lo:hi] if lo < hi else ""
            pairs = _spelt(part) if spelt and part else []
            if not pairs and not _DIGIT.search(part):
                continue
            words = [(lo + m.start(), lo + m.end()) for m in _TOKEN.finditer(part)]
            near = set()
            for i, (a, b) in enumerate(words):
                if _DIGIT.search(text, a, b) or any(a < lo + q and b > lo + p for p, q in pairs):
                    near.update(range(i - REACH, i + REACH + 1))
            last = None
            for i in sorted(k for k in near if 0 <= k < len(words)):
                if last is None or i > last + 1:
                    out.append([])
                out[-1].append(words[i])
                last = i
        begin = end + 1
    return out


_ALPHA, _NUM = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE:
        a += 1
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    return a, b


_SPELT_AT = re.compile(r"\s*(?:[\[({<]\s?at\s?[\])}>]|(?<!\S)at(?!\S)|@)\s*", re.I)
_SPELT_DOT = re.compile(r"\s*(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|(?<!\S)dot(?!\S))\s*", re.I)
_MAIL, _QUAD = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+"), re.compile(r"\d{1,3}(\.\d{1,3}){3}")


def _span_features(text: str, a: int, b: int, words: int, last: str) -> list[str]:
    """Features of a whole span: its shape, also with signs written as such, its runs of digits, its ends."""
    s = text[a:b]
    plain = _SPELT_DOT.sub(".", _SPELT_AT.sub("@", s))
    d = _only_digits(s)
    letters = sum(c.isalpha() for c in plain)
    shape = _ALPHA.sub("a", _NUM.sub(lambda m: str(min(9, len(m[0]))), plain))
    runs = "-".join(str(min(9, len(x))) for x in _NUM.findall(s)[:7])
    clear = bool(re.search(r"@|[\[({<]\s?(?:at|dot|\.)\s?[\])}>]", s, re.I))  # a sign that no word is
    form = f"{_MAIL.fullmatch(plain) is not None}{_QUAD.fullmatch(plain) is not None}{letters > 0}"
    out = [f"n{words}", f"d{min(len(d), 20)}", f"s{shape[:32]}", f"k{_ALPHA.sub('a', _NUM.sub('9', plain))[:24]}", f"l{last}", f"f{form}", f"f{form}{words}", f"c{clear}{form}", f"r{runs}{letters > 0}"]
    out += [f"x{s[:1].isdigit()}{s[-1:].isdigit()}{s[:1] in '+('}{letters > 0}", f"p{'@' in plain}{'.' in plain}{min(letters, 3)}"]
    if 12 <= len(d) <= 20:
        out.append(f"luhn{luhn(d)}{letters > 0}")
    parts = re.split(r"[^0-9]+", plain)
    if len(parts) == 4:
        out.append(f"quad{all(p and len(p) <= 3 and int(p) <= 255 for p in parts)}{letters > 0}")
    return out


class Field:
    """Weights of a semi-Markov field over zones; a feature has one for each label."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}

    def lattice(self, text: str, words: list[tuple[int, int]]):
        """[end] -> [(start, label, score, features)] of all segments."""
        most = max(LONGEST)
        out: list[list] = [[] for _ in range(len(words) + 1)]
        names = [_ALPHA.findall(text[a:b])[-1:] for a, b in words]
        before = text[max(0, words[0][0] - 40) : words[0][0]].split("\n")[-1].split()[-1:] if words else []
        names.append(_ALPHA.findall(before[0])[-1:] if before else [])  # of the word before the first
        numbers = [bool(_DIGIT.search(text, a, b)) for a, b in words]
        pairs = [(words[0][0] + p, words[0][0] + q) for p, q in _spelt(text[words[0][0] : words[-1][1]])] if words else []
        for i in range(len(words)):
            last = names[i - 1][0].lower()[:12] if names[i - 1] else ""
            number = False
            for j in range(i + 1, min(len(words), i + most) + 1):
                number = number or numbers[j - 1]
                spelt = any(words[i][0] <= p and q <= words[j - 1][1] for p, q in pairs)
                if j > i + 1 and not number and not spelt:
                    continue
                a, b = _trimmed(text, words[i][0], words[j - 1][1])
                if a >= b and j > i + 1:
                    continue
                f = _span_features(text, a, b, j - i, last)
                rows = [self.w.get(x) for x in f]
                for label in range(5):
                    if j - i <= LONGEST[label] and (not label or a < b and (spelt if label == 1 else number)):
                        out[j].append((i, label, sum(r[label] for r in rows if r), f))
        return out

    def forward_backward(self, segments):
        n = len(segments) - 1
        f, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            f[j] = _logsum([f[i] + s for i, _, s, _ in segments[j]])
        for j in range(n, 0, -1):
            for i, _, s, _ in segments[j]:
                b[i] = _logsum([b[i], s + b[j]])
        return f, b

    def step(self, text, words, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step of likelihood ascent on a zone; gold: (first word, end) -> label of its spans."""
        segments = self.lattice(text, words)
        f, b = self.forward_backward(segments)
        covered = {k for i, j in gold for k in range(i, j)}
        for j in range(1, len(segments)):
            for i, label, s, names in segments[j]:
                true = gold.get((i, j)) == label if label else j - 1 not in covered
                g = true - math.exp(min(0.0, f[i] + s + b[j] - f[-1]))
                if abs(g) > 1e-4:
                    for x in names:
                        row = self.w.setdefault(x, [0.0] * 5)
                        row[label] += rate * (g - 1e-3 * row[label])

    def best(self, text, words, sure: float) -> list[tuple[int, str, int]]:
        """The spans of the best segmentation whose segment has a probability of at least `sure`."""
        segments = self.lattice(text, words)
        f, b = self.forward_backward(segments)
        n = len(words)
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            for i, label, s, _ in segments[j]:
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, label, s)
        out, j = [], n
        while j:
            i, label, s = back[j]
            if label and f[i] + s + b[j] - f[-1] >= math.log(sure):
                a, e = _trimmed(text, words[i][0], words[j - 1][1])
                out.append((a, KINDS[label - 1], e))
            j = i
        return out[::-1]


def _logsum(x: list[float]) -> float:
    m = max(x, default=-math.inf)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in x))


def _disguised(kind: str, s: str, k: int) -> str:
    """Another way to write a span of a kind; k chooses which."""
    d = _only_digits(s)
    if kind == "email":
        user, host = s.split("@", 1)
        forms = [f"{user} at {host.replace('.', ' dot ')}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user} [at] {host}", f"{user} at {host}", f"{user} AT {host.replace('.', ' DOT ')}", f"{user}(at){host}", f"{user} @ {host}", f"{user} {{at}} {host.replace('.', ' {dot} ')}"]
    elif kind == "ip":
        forms = [s.replace(".", "[.]"), s.replace(".", " dot "), s.replace(".", "(.)"), s.replace(".", "[dot]")]
    elif kind == "card":
        forms = [x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in (".", "/", "_", " - ")]
    else:
        d = d[-10:]
        forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+1 {d[:3]} {d[3:6]} {d[6:]}"]
    return forms[k % len(forms)]


def invented(kind: str, rng: random.Random) -> str:
    """A span of a kind, made up: invalid as a number of anyone but in its form."""
    some = lambda n: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n))
    if kind == "email":
        user = some(rng.randint(1, 3)) + rng.choice(["", f".{some(2)}", f"_{some(1)}", str(rng.randint(1, 99))])
        return f"{user}@{rng.choice(['', 'mail.'])}{some(rng.randint(2, 3))}.{rng.choice(['org', 'com', 'net', 'example'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))
    d = str(rng.randint(200, 999)) + "555" + f"{rng.randint(0, 9999):04}"
    return f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"


#: Text that holds signs and no personal data.
_DECOYS = ("version 4.0 of 2024-05-17 and", "page 12 of 340 at 10:45 on", "costs 1,299.00 or 55 % of 3000", "id 20240517103045 and key=9f8e7d6c5b4a", "build 10.2.14 rev 88123", "order 1234567890123 of 17", "pi is 3.14159 at most", "meet at the dot on", "look at this dot there", "section 1.2.3 has 4.5.6 in it", "meet at noon. The dot is", "see it at www.example.org today", "on 12.05.2024 at 10.30 in", "from 1999 to 2004 and 17 more", "sold at 3.50 each, dot com or not")


def learn(texts: list[str], rounds: int = 14, rate: float = 0.4, most: int = 240, seed: int = 5) -> Field:
    """A field from texts: other ways to write a span, among words of the texts, are what to find; all else
    near signs is not. Spans are those of the fixed patterns in the texts, and invented ones."""
    examples: list[tuple[str, dict[str, int], list]] = []
    plain = []
    for text in texts:
        spans = base_spans(text)
        for a, kind, b in spans:
            # words around a span, never those of another one
            lo = max([0, a - 60, *(e for _, _, e in spans if e <= a)])
            hi = min([len(text), b + 60, *(x for x, _, _ in spans if x >= b)])
            before, after = text[lo:a].split("\n")[-1].split(" ", 1)[-1], text[b:hi].split("\n")[0].rsplit(" ", 1)[0]
            examples.append((before, kind, text[a:b], after))
        plain += [(text, z) for z in zones(text, merged(spans))]
    count = {k: 0 for k in KINDS}
    made = []
    for before, kind, s, after in examples:
        if count[kind] < most // 6 and kind == next((k for _, k, _ in base_spans(s)), None):
            made.append((before, kind, _disguised(kind, s, count[kind]), after))
            count[kind] += 1
    rng = random.Random(seed)
    frames = [(b, a) for b, _, _, a in examples[:10]] + [("reach me by ", " any time"), ("", ""), ("it was sent to ", ", he said"), ("the number ", " is new")]
    for kind in KINDS:
        for k in range(most // 5):
            before, after = frames[k % len(frames)]
            made.append((before, kind, _disguised(kind, invented(kind, rng), k), after))
    # a number that runs on into an address behind it is none to the fixed pattern
    made += [(frames[k % len(frames)][0], "phone", _disguised("phone", invented("phone", rng), 4 + k), f" {invented('ip', rng)} up") for k in range(most // 8)]
    field = Field()
    jobs = [(b + s + a, (len(b), len(b) + len(s), KINDS.index(kind) + 1)) for b, kind, s, a in made] + [(d, None) for d in _DECOYS * 3]
    for r in range(rounds):
        for text, gold in jobs:
            fixed = [t for t in merged(base_spans(text)) if not gold or t[0] >= gold[1] or t[1] <= gold[0]]
            for z in zones(text, fixed):
                own = {}
                if gold:
                    inside = [i for i, (a, b) in enumerate(z) if a < gold[1] and b > gold[0]]
                    if inside and inside[-1] + 1 - inside[0] <= LONGEST[gold[2]]:
                        own = {(inside[0], inside[-1] + 1): gold[2]}
                    elif inside:
                        continue
                field.step(text, z, own, rate / (1 + r))
        for text, z in plain[:most]:
            field.step(text, z, {}, rate / (1 + r))
    return field


def merged(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover; those of several kinds may overlap."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fit(docs: DataFrame, sample: int = 300) -> Field:
    """A field from at most `sample` documents with a digit, those first by a hash of doc_id and text; equal rows count once."""
    x = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).where(F.col("text").rlike("[0-9]"))
    ids = x.select("doc_id", F.xxhash64("doc_id", "text").alias("tie")).orderBy("tie", "doc_id").limit(sample)
    got = x.withColumn("tie", F.xxhash64("doc_id", "text")).join(F.broadcast(ids.select("tie").distinct()), "tie", "left_semi").groupBy("tie").agg(F.min("text").alias("text"))  # at most `sample` numbers
    return learn([r[1] for r in sorted(got.collect())])


def find(docs: DataFrame, field: Field, sure: float = 0.9) -> DataFrame:
    """Spans of personal data in each text: doc_id, counts and hash of the fixed patterns, all spans.

    Returns doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans
    (kind:start:end in code points, end exclusive, by start then kind, comma-joined) and n_spans.

    The field adds spans that no fixed pattern covers: features of whole candidate spans score segments, and
    dynamic programming over the words of every text chooses boundaries and kinds together (zones() says which
    words can only be "nothing" and so need no step). A segment of a kind has at most LONGEST words. A span is added where its
    segment is in the best segmentation and has a probability of at least `sure`. n_spans counts all spans.
    Null or empty text: no spans. Repeated rows and null doc_ids are documents like others.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # weights of one sample, bounded

    def row(doc_id, text):
        text = text or ""
        base = base_spans(text)
        added = []
        for z in zones(text, merged(base)):
            added += sent.value.best(text, z, sure)
        write = lambda s: ",".join(f"{k}:{a}:{b}" for a, k, b in s)
        counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
        every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1])))
        return doc_id, *counts, hashlib.sha256(write(base).encode()).hexdigest(), write(every), len(every)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [row(i, t) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and spans of personal data of every row of documents; see find(). Repeated rows each come back."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
