"""Line deduplication by winnowing, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import column, cut, free, small_batches, table

#: Lines of the shortest repeated run that is deleted.
RUN = 3


def _blank(x):
    return F.btrim(x, F.lit(" \t\r\x0b\x0c")) == ""


def _prepared(docs: DataFrame) -> DataFrame:
    """The document's key (_id, _tie), and the hashes of its lines that are not blank, trimmed (_h)."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    hashes = F.transform(F.filter(F.split(text, "\n"), lambda x: ~_blank(x)), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c"))))
    return docs.select(column(docs, "doc_id", "long").alias("_id"), F.xxhash64(text).alias("_tie"), hashes.alias("_h"))


def fingerprints(rows: DataFrame, run: int) -> DataFrame:
    """(_id, _tie, fp, at, windows): the places that winnowing selects, and what lies around each.

    Of each `run` neighbouring lines the least hash is selected, the last one of equal ones. Neighbouring
    windows mostly select the same place, which comes once. windows has, for each of them, where it
    begins and a hash of the place's line with those before and behind it in the window.
    """
    chosen = F.transform(F.sequence(F.lit(0), F.size("_h") - run), lambda s: s + run - F.array_position(F.reverse(F.slice("_h", s + 1, run)), F.array_min(F.slice("_h", s + 1, run))).cast("int"))
    places = rows.withColumn("_chosen", chosen).select("_id", "_tie", "_h", "_chosen", F.explode(F.array_distinct("_chosen")).alias("at"))
    near = F.sequence(F.greatest(F.lit(0), F.col("at") - (run - 1)), F.least(F.col("at"), F.size("_h") - run))
    own = F.filter(near, lambda s: F.get("_chosen", s) == F.col("at"))
    windows = F.transform(own, lambda s: F.struct(s.alias("begin"), F.xxhash64(F.slice("_h", s + 1, run)).alias("lines")))
    return places.select("_id", "_tie", F.get("_h", F.col("at")).alias("fp"), "at", windows.alias("windows"))


def repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(_id, _tie, _begins): where stretches of `run` lines to delete begin, in lines that are not blank, from 0.

    Winnowing guarantees that two equal runs of at least `run` lines have a selected fingerprint in each
    `run` lines of them, at the same places. So only selected places are moved, one row each, and of
    these only the ones whose fingerprint occurs more than once go on. A place is joined with the first place, in order
    of (doc_id, hash of the text, line), of the same fingerprint that has the same lines before and behind it, for each way
    to extend it to both sides to `run` lines. Where the place itself comes later, these lines
    are deleted; longer runs are unions of such extensions, as their places lie less than `run` lines apart.
    """
    rows = _prepared(docs).where(F.size("_h") >= run)
    places = fingerprints(rows, run)
    shared = places.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    met = cut(places.join(shared, "fp", "left_semi"))
    sides = met.select("_id", "_tie", "fp", F.explode("windows").alias("w")).select("_id", "_tie", "fp", "w.lines", "w.begin")
    first = sides.groupBy("fp", "lines").agg(F.min(F.struct("_id", "_tie", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").select("fp", "lines", "first")
    later = sides.join(first, ["fp", "lines"]).where(F.struct("_id", "_tie", "begin") > F.col("first"))
    return later.groupBy("_id", "_tie").agg(F.collect_set("begin").alias("_begins"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with later occurrences of repeated runs of at least `run` lines deleted, in all its columns.

    text loses these lines; n_chars, where docs has it, follows; no column is added, and none of docs is taken for
    an own one, whatever its name. Lines compare without white space around them; blank lines don't count as
    lines and stay, except that a text of which no other line is left becomes empty. Order is by
    doc_id (null first), then by a hash of the text, so the first occurrence is never deleted; rows
    that repeat a doc_id with the same text are one place and keep the same lines. Null text stays null.
    """
    small_batches(docs.sparkSession)
    own, same, begins, numbers, gone = free(docs, "own", "same", "begins", "numbers", "gone")
    deletions = repeated_lines(docs, run).toDF(f"{own}_id", f"{own}_tie", begins)
    marked = docs.withColumns({own: column(docs, "doc_id", "long"), same: F.xxhash64(F.coalesce(column(docs, "text", "string"), F.lit("")))})
    joined = marked.join(deletions, F.col(own).eqNullSafe(F.col(f"{own}_id")) & (F.col(same) == F.col(f"{own}_tie")), "left")
    filled = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~_blank(x), i.cast("int"))), lambda i: i.isNotNull())
    lines = F.array_distinct(F.flatten(F.transform(begins, lambda s: F.slice(numbers, s + 1, run))))
    joined = joined.withColumn(numbers, F.when(F.col(begins).isNotNull(), filled)).withColumn(gone, lines)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i.cast("int")))
    new = F.when(F.exists(kept, lambda x: ~_blank(x)), F.array_join(kept, "\n")).otherwise(F.lit(""))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines_deleted and the SHA-256 of the text that is left (null: of an empty one), for every document.

    Ties, repeats and nulls as in drop_repeated_lines; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~_blank(x)))
    out = drop_repeated_lines(docs.withColumn("n_lines", count))
    return out.select("doc_id", (F.col("n_lines") - count).cast("long").alias("n_lines_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
m as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t from l),
n as (select doc_id, p, t, row_number() over (partition by doc_id order by p) - 1 as pos from m where t <> ''),
w as (select doc_id, pos, t || chr(10) || lead(t, 1) over o || chr(10) || lead(t, 2) over o as k from n window o as (partition by doc_id order by pos)),
f as (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) as r from w where k is not null),
g as (select distinct doc_id, pos + i as pos from f, (values (0), (1), (2)) v(i) where r > 1),
x as (select m.doc_id, m.p, m.line, m.t, g.doc_id is not null as gone from m left join n using (doc_id, p) left join g on g.doc_id = m.doc_id and g.pos = n.pos),
y as (select doc_id, cast(count(*) filter (gone) as bigint) as c, coalesce(string_agg(line, chr(10) order by p) filter (not gone), '') as s, bool_or(t <> '' and not gone) as any_left from x group by doc_id)
select doc_id, c as n_lines_deleted, sha256(case when c > 0 and not any_left then '' else s end) as text_sha256 from y
"""
