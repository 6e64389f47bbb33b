"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import column, cut, mix, raw, release, seeds, sets, shingles, small_batches, steps, table, words
from ._graph import components

_U = np.uint64
#: Bands and coordinates of a band: a pair of similarity 0.75 shares none with probability 1e-4, one of
#: 0.8 with 3e-7.
BANDS, ROWS = 64, 7


def sketch(h: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches of sets of hashes that lie in a row: (sets, bins).

    Round i below `bins` places every element in a hashed bin with value i + hash; round `bins` + j
    places all in bin j. A set leaves as soon as all its bins are filled, so a set of more than a few
    times `bins` elements needs a few rounds, and every bin of any set that is not empty gets a value.
    """
    n = len(counts)
    full = np.iinfo(np.uint64).max
    out = np.full(n * bins, full, _U)
    row = np.repeat(np.arange(n), counts)
    salt = seeds(2 * bins, 5000)
    live = np.array(counts) > 0
    for i in range(2 * bins):
        if i >= bins:
            missing = live & (out.reshape(n, bins)[:, i - bins] == full)
            take = missing[row]
            if not take.any():
                continue
            r, x = row[take], h[take]
        else:
            r, x = row, h
        x = mix(x ^ salt[i])
        at = r * bins + (x % _U(bins)).astype(np.int64) if i < bins else r * bins + (i - bins)
        np.minimum.at(out, at, (_U(i) << _U(54)) | (x >> _U(10)))
        if i < bins:
            live &= (out.reshape(n, bins) == full).any(axis=1)
            if not live.any():
                break
            keep = live[row]
            row, h = row[keep], h[keep]
    return out.reshape(n, bins)


def _digests(bands: int, rows: int):
    salt = seeds(rows, 9000) | _U(1)

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in steps(offsets):
                h, counts = shingles(*words(data, offsets[lo : hi + 1]))
                ends = np.cumsum(counts)
                each = [np.unique(h[e - c : e]) for e, c in zip(ends, counts, strict=True)]
                sizes = np.array([len(s) for s in each], np.int64)
                flat = np.concatenate(each)
                some = sizes > 0
                d1, d2 = np.zeros(hi - lo, _U), np.zeros(hi - lo, _U)
                if some.any():
                    starts = (np.cumsum(sizes) - sizes)[some]
                    d1[some] = np.add.reduceat(mix(flat ^ _U(0x1234567)), starts)
                    d2[some] = np.bitwise_xor.reduceat(mix(flat + _U(0x7654321)), starts)
                s = mix(sketch(flat, sizes, bands * rows)).reshape(hi - lo, bands, rows)
                s *= salt
                keys = mix(s.sum(axis=2, dtype=_U) + np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), keys], ["doc_id", "n", "d1", "d2", "keys"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ok = []
                for a, b in zip(*(sets(part.column(i), part.column(t)) for i, t in (("u", "text_u"), ("v", "text_v"))), strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                    ok.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column(c).take(keep) for c in ("u", "v")], ["u", "v"])

    return run


def _edits(batches):
    """Of each text u and its pivot v: how many shingles only v and only u has, and all these."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            less, more, both = [], [], []
            for a, b in zip(*(sets(part.column(i), part.column(t)) for i, t in (("u", "text_u"), ("v", "text_v"))), strict=True):
                lost, new = np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)
                less.append(len(lost))
                more.append(len(new))
                both.append(np.concatenate([lost, new]).view(np.int64))
            each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, both)]), pa.int32()), pa.array(np.concatenate(both)))
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), pa.array(less, pa.int64()), pa.array(more, pa.int64()), each], ["u", "v", "less", "more", "edits"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v, text_u, text_v; rows of one v follow each other."""
    for side in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("u", "v", "text_u", "text_v")


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs that pairs (u, v) name."""
    named = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    return docs.join(named, "doc_id", "left_semi")


def edited_alike(group: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs that may be similar, of the members u of each pivot's group in different components.

    group: u, n (size of its set), comp, v (the pivot), pn, pc. A member's edits against its pivot are the
    shingles that only one of them has: `less` of the pivot's and `more` of its own. Two members have
    pn - less - less' - more and more' apart from the edits that they share, so
    they reach the similarity only if they share at least
      (100 (less + less') + percent (more + more') - (100 - percent) pn) / (100 + percent)
    edits. One of them is out of the pivot's component and for it alone the sum 100 less + percent more
    exceeds (100 - percent) pn, or it would be linked with the pivot. So each member must share an edit among its
    rarest ones, as many as leave fewer than the least number that it must share; edits that no other member, or no
    member out of the component, has come first and pair nothing. Nothing similar is lost: all is counted on full sets.
    """
    edits = _with_texts(group.select("u", "v"), texts).mapInArrow(_edits, "u long, v long, less long, more long, edits array<long>")
    edits = cut(edits.join(group.withColumn("out", F.col("comp") != F.col("pc")), ["u", "v"]))
    weight = F.expr(f"100 * less + {percent} * more")
    free_ = F.expr(f"{100 - percent} * pn")
    # the fewest edits shared with a member of the pivot's component, and with one out of it
    edits = edits.withColumns({"weight": weight, "inside": F.greatest(F.lit(1), F.ceil((weight - free_) / 100)), "outside": F.greatest(F.lit(1), F.ceil((weight + 1) / (100 + percent)))})
    each = edits.select("u", "v", "out", F.explode("edits").alias("x"))
    known = each.groupBy("v", "x").agg(F.count("*").alias("df"), F.max("out").alias("any")).where("df > 1 and any").select("v", "x", "df")
    rare = each.join(known, ["v", "x"]).groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("rare"))
    rows = edits.drop("edits").join(rare, ["u", "v"])
    alone = F.col("less") + F.col("more") - F.size("rare")
    place = rows.withColumn("alone", alone).select("*", F.posexplode("rare").alias("i", "e")).withColumn("i", F.col("i") + F.col("alone") + 1)
    place = place.withColumns({"left": F.col("less") + F.col("more") - F.col("i"), "near": F.expr("i <= less + more - outside + 1")})
    place = place.where("near or (out and i <= less + more - inside + 1)").select("v", F.col("e.x").alias("x"), "u", "n", "comp", "out", "weight", "left", "near", "pn")
    a = place.where("out").alias("a")
    b = place.where("near").alias("b")
    on = (F.col("a.v") == F.col("b.v")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.comp") != F.col("b.comp"))
    on &= F.expr("not b.out or (a.near and a.u < b.u)")
    on &= F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
    on &= F.expr(f"{100 + percent} * (1 + least(a.left, b.left)) >= a.weight + b.weight - {100 - percent} * a.pn")
    return a.join(b, on).select(F.least("a.u", "b.u").alias("u"), F.greatest("a.u", "b.u").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least percent/100 on 5-word shingles.

    Returns doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Rows whose sets are equal form one class; only class representatives (the smallest doc_id) are
    sketched against others. In a bucket of equal bands every member is compared with one pivot, the member
    that meets most others over all its buckets. Where a bucket then still holds several components, its
    members are compared with each other by their edits against the pivot (edited_alike), which finds all pairs
    that may reach the similarity without looking at the others, and those are verified. All links are confirmed on
    full sets; a bucket of thousands of copies of one text costs a row for each. Probability enters only
    through the bands: a link of similarity 0.75 exactly is in no common bucket with probability 1e-4, one of 0.8 with 3e-7.

    Null text: empty, linked with nothing. Rows that repeat a doc_id stand for one document with
    several texts; each row comes back. A null doc_id can't be named in a class: such a row comes back
    with component_id null and kept true. Ties of ids are broken to the smaller one. Extra columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    base = cut(docs.mapInArrow(_digests(bands, rows), "doc_id long, n long, d1 long, d2 long, keys array<long>"))
    named = base.where("doc_id is not null and n > 0")
    classes = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"))
    bucket = classes.select("rep", "n", F.explode("keys").alias("key"))
    several = bucket.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    active = cut(bucket.join(several, "key").select("key", "rep", "n", "members"))
    release(docs)
    # a text that its copies were made from meets more of them than they meet each other: it is a good pivot
    met = active.groupBy("rep").agg(F.sum("members").alias("met"))
    best = F.max(F.struct("met", (-F.col("rep")).alias("r"), F.col("n").alias("pn"))).alias("p")
    central = active.join(met, "rep").groupBy("key").agg(best, F.count("*").alias("members")).select("key", (-F.col("p.r")).alias("p"), "p.pn", "members")
    met_by = cut(active.select("key", "rep", "n").join(central, "key").where("rep != p"))
    del active, met, central
    release(docs)
    alike = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"  # no pair beyond is similar enough
    pairs = cut(met_by.where(alike).select(F.col("rep").alias("u"), F.col("p").alias("v")).distinct())
    links = cut(same_id_links(named).union(_with_texts(pairs, texts_of(pairs, docs)).mapInArrow(_verified(percent), "u long, v long")).distinct())
    release(docs)
    comp = components(links)
    own = comp.select(F.col("v").alias("rep"), "comp")
    state = met_by.where("members > 2").join(own, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    state = state.join(own.select(F.col("rep").alias("p"), F.col("comp").alias("pc")), "p", "left").withColumn("pc", F.coalesce("pc", "p"))
    mixed = state.groupBy("key").agg(F.max(F.expr("comp != pc")).alias("out"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("out and lo < hi").select("key")
    group = cut(state.join(mixed, "key", "left_semi").select(F.col("rep").alias("u"), "n", "comp", F.col("p").alias("v"), "pn", "pc").distinct())
    release(docs)
    if not group.isEmpty():
        texts = cut(texts_of(group, docs))  # few are left by now
        release(docs)
        more = cut(edited_alike(group, texts, percent))
        release(docs)
        links = cut(links.union(_with_texts(more, texts).mapInArrow(_verified(percent), "u long, v long")))
        del texts
        release(docs)
        comp = components(links)
    release(docs)
    reps = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    out = base.drop("keys").join(reps, ["n", "d1", "d2"], "left").withColumn("rep", F.when(F.expr("n > 0 and doc_id is not null"), F.col("rep")).otherwise(F.col("doc_id")))
    out = out.join(comp, F.col("rep") == F.col("v"), "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def same_id_links(named: DataFrame) -> DataFrame:
    """Links that a repeated doc_id makes between the classes of its several texts."""
    reps = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    twice = named.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("lo"), F.max(F.struct("n", "d1", "d2")).alias("hi")).where("lo != hi").select("doc_id")
    return named.join(twice, "doc_id", "left_semi").join(reps, ["n", "d1", "d2"]).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t from documents),
s as (
  select doc_id, case when t is null or len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')]
    else list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) end as g from w),
n as (select doc_id, cast(len(g) as bigint) as n from s),
f as (select doc_id, unnest(g) as x from s),
e as (select doc_id, hash(x) as x from f where x in (select x from f group by x having count(*) > 1)),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 75 * (a.n + b.n - c)),
r as (select doc_id as s, doc_id as at from n union select r.s, l.v from r join l on l.u = r.at)
select n.doc_id, n.n as n_shingles, min(r.at) as component_id, n.doc_id = min(r.at) as kept
from n join r on r.s = n.doc_id group by n.doc_id, n.n
"""
