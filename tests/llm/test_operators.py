"""Corpus operators against brute force on small tables, with nulls, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import digest, language, lines, minhash, mixing, neighbours, packing, passages, private, quality

W = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(80))
TEXTS = [None, "", "  \n", "one two", "One TWO", BASE, BASE.replace("w40 ", "x "), BASE + " tail", "a\nb\nc\nd", "q\na\nb\nc\ne", "a a a a a a a a", "été déjà vu", "12 34", " ".join(f"z{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "fr" if i % 3 == 0 else None, None if i == 1 else f"s{i % 3}", len(t or ""), i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id", None, "s0", 5, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(TEXTS)}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), comp[i], comp[i] == i)
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 63, 80).astype(np.uint64)])
    s = minhash.sketch(np.concatenate([a, b, a[:1]]), np.array([400, 400, 1]), 448)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, with_ids=True).toPandas()
    t = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in [(r.doc_id, r.text) for r in docs.collect()])
    one = got.fillna({"doc_id": -1})
    # a repeated row makes its own pieces
    assert sum(n for _, n in want) == one.length.sum()
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty, path).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(rng.integers(1, 2048, 5000), return_counts=True)), strict=True))
    bins = packing.plan(counts, 2048, (2, 3, 4), 32)
    placed: dict = {}
    for content, n in bins:
        assert sum(x * k for x, k in content) <= 2048
        for x, k in content:
            placed[x] = placed.get(x, 0) + n * k
    assert placed == counts
    assert sum(n for _, n in bins) <= 1.02 * sum(x * c for x, c in counts.items()) / 2048


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:110] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0")).toPandas()
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hit = 0
    for i in range(0, 600, 50):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(600), -np.round(s, 9))) if j != i][:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 5
        hit += len(set(order) & set(mine.vec_id))
    assert hit >= 0.9 * 60
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def brute_lines(texts, run=3):
    out, seen = {}, set()
    for i, t in texts:
        ls = (t or "").split("\n")
        at = [k for k, x in enumerate(ls) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(at) - run + 1):
            key = tuple(ls[j].strip(" \t\r\x0b\x0c") for j in at[k : k + run])
            gone |= set(at[k : k + run]) if key in seen else set()
            seen.add(key)
        left = [x for k, x in enumerate(ls) if k not in gone]
        out[i] = t if not gone else "\n".join(left) if any(x.strip() for x in left) else ""
    return out


def test_lines(docs, empty):
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs.where("doc_id is not null")).collect()}
    for i, t in brute_lines(enumerate(TEXTS)).items():
        assert got[i].text == t and got[i].n_chars == len(t or "")
    assert lines.drop_repeated_lines(empty).count() == 0


def test_private():
    text = "mail kim@x.org, 192.0.2.1 or +1 (202) 555-0143; 4111 1111 1111 1111 and 999.1.1.1"
    spans = private.base_spans(text)
    assert [(k, text[a:b]) for a, k, b in spans] == [("email", "kim@x.org"), ("ip", "192.0.2.1"), ("phone", "+1 (202) 555-0143"), ("card", "4111 1111 1111 1111")]
    field = private.learn([text + f" on day {i}" for i in range(20)])
    for hidden, kind, span in (("call (202) 555-0188 now", "phone", "(202) 555-0188"), ("bob[at]mail[dot]org is it", "email", "bob[at]mail[dot]org"), ("host 10[.]0[.]0[.]7 up", "ip", "10[.]0[.]0[.]7")):
        assert [(k, hidden[a:b]) for z in private.zones(hidden, []) for a, k, b in field.best(hidden, z, 0.9)] == [(kind, span)]
    clean = "it was 14 days and 3.5 miles, see page 12 of 340 at 10:45"
    assert not [s for z in private.zones(clean, []) for s in field.best(clean, z, 0.9)]


def test_private_rows(docs, empty):
    field = private.learn(["call +1 202 555 0143 now"])
    got = private.find(docs, field).toPandas()
    assert len(got) == docs.count() and (got.n_email == 0).all()
    assert private.find(empty, field).count() == 0


def test_passages(docs, empty):
    got = passages.repeated_passages(docs)
    ids = {x for r in got.collect() for x in (r.doc_id, r.with_id)}
    assert ids == {5, 6, 7}
    assert passages.repeated_passages(empty).count() == 0


def hashed(w):
    return passages.shingles(np.array(w, np.uint64), np.array([len(w)]))[0]


def test_digests_of_copies_are_equal():
    one = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for d in passages._digests(np.tile(one, 500), np.full(500, 60)):
        assert len(set(d.tolist())) == 1


def test_passages_with_edits():
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 1 << 62, n).tolist()
    for n in (50, 55, 60, 70, 80):
        for k in range(n):
            p = some(n)
            q = p[:k] + some(1) + p[k + 1 :]
            (found,) = passages.matched(hashed(some(60) + p + some(40)), hashed(some(30) + q + some(90)), 46, 75)
            s, e, x, y = found
            assert s <= 30 + (k + 1 if k < 5 else 0) and e >= 30 + n - 4 - (n - k if k >= n - 5 else 0) and x - 60 == s - 30 and y - 60 == e - 30
    p = some(100)
    q = p[:33] + some(1) + p[34:66] + some(1) + p[67:]
    assert passages.matched(hashed(some(60) + p), hashed(some(30) + q), 46, 75) == [(30, 126, 60, 156)]
    assert passages.matched(hashed(some(20) + p[:50] + some(6) + p[50:]), hashed(p), 46, 75) == [(0, 96, 20, 122)]


def pairs_of(df):
    return {(r.doc_id, r.with_id) for r in df.collect()}


def around(rng, n, middle):
    some = lambda: [f"f{x}" for x in rng.integers(0, 1 << 40, n)]
    return " ".join(some() + middle + some())


SHARED = [f"q{i}" for i in range(60)]


def frequent(rng, n):
    """Texts with 40 words of SHARED each: too few for a passage, enough for its groups."""
    return [around(rng, 20, SHARED[i % 21 : i % 21 + 40]) for i in range(n)]


def test_passages_where_the_largest_id_is_a_copy(spark):
    rng = np.random.default_rng(5)
    b, c = around(rng, 40, SHARED), around(rng, 40, SHARED)
    rows = list(enumerate(frequent(rng, 84))) + [(102, b), (103, c), (104, b)]
    got = pairs_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {(103, 102), (104, 102)}


def test_passages_of_the_least_length_are_candidates(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        p = [f"f{x}" for x in rng.integers(0, 1 << 40, 51)]
        k = int(rng.integers(4, 46))
        rows += [(2 * i, " ".join(p[:50])), (2 * i + 1, " ".join(p[:k] + p[50:] + p[k + 1 : 50]))]
    got = pairs_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {(2 * i + 1, 2 * i) for i in range(600)}


def test_passages_between_the_ends_of_a_group(spark):
    rng = np.random.default_rng(6)
    common = frequent(rng, 168)
    rows = list(enumerate(common[:84])) + [(102, around(rng, 40, SHARED)), (103, around(rng, 40, SHARED))] + list(enumerate(common[84:], 200))
    got = pairs_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {(103, 102)}


def test_language(docs, empty):
    f = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, f).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[12].lang_pred == "und"
    assert got[3].lang_pred == "fr" and "component_id" in got[3].asDict()
    assert language.identify(empty, f).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def test_fingerprints(docs, empty):
    got = digest.fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), parts=3).collect()
    n = len(TEXTS)
    for r in got:
        t, after = TEXTS[r.doc_id] or "", TEXTS[(r.doc_id - 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == digest.fingerprint(t.encode()) and r.edited_fingerprint == digest.fingerprint(edited.encode())
    assert len(got) == n and digest.fingerprints(docs).count() == docs.count()
    assert digest.fingerprints(empty).count() == 0


def test_quality(spark, docs, empty):
    rows = [(i, ("A fine line of words here.\nAnother good one follows it." if i % 2 else "!!! ### BUY NOW !!!\n$$$ $$$ WIN !!!")) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    field = quality.fit(d, labels)
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) for r in quality.score(d, field).collect())
    assert quality.score(docs, field).count() == docs.count() and quality.score(empty, field).count() == 0
    assert quality.fit(empty, labels).scores(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape == (1,)


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs, block=16).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby(got.source.fillna("~")):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= 1
    mixed = mixing.mixed_documents(docs, block=16).collect()
    assert sum(len(W.findall(r.text or "")) for r in mixed) == got.taken.sum()
    assert mixing.mix_sources(empty).count() == 0


def test_permutation():
    for n in (1, 2, 5, 100, 1000):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7, np.uint64))
        assert sorted(x.tolist()) == list(range(n))
