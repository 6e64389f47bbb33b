"""Chunk generators: one text to many blocks of lines (0-based, inclusive), without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import lines, tokens


def _blank(x: Column) -> Column:
    return F.trim(x) == ""


def _blocks(docs: DataFrame, starts: Column, bounds, key: str) -> DataFrame:
    rows = docs.withColumn("_l", lines(F.col("text"))).select(key, "_l", F.explode(starts).alias("_i"))
    lo, hi = bounds(F.col("_i"), F.size("_l"))
    cut = rows.select(key, lo.cast("int").alias("start_line"), (hi - 1).cast("int").alias("end_line"), F.slice("_l", lo.cast("int") + 1, (hi - lo).cast("int")).alias("_b"))
    return cut.where(F.exists("_b", lambda x: ~_blank(x))).select(key, "start_line", "end_line", F.array_join("_b", "\n").alias("content"))


def fixed(docs: DataFrame, size: int = 15, key: str = "doc_id") -> DataFrame:
    """Blocks of `size` lines in a row; blocks of blank lines alone go."""
    starts = F.sequence(F.lit(0), F.size("_l") - 1, F.lit(size))
    return _blocks(docs, starts, lambda i, n: (i, F.least(n, i + size)), key)


def sliding(docs: DataFrame, window: int = 20, slices: int = 2, key: str = "doc_id") -> DataFrame:
    """Windows around every step-th line: half a window before it, the rest after."""
    delta, step = window // 2, max(1, window // slices) if slices > 0 else window
    starts = F.sequence(F.lit(0), F.size("_l") - 1, F.lit(step))
    return _blocks(docs, starts, lambda i, n: (F.greatest(F.lit(0), i - delta), F.least(n, i + window - delta)), key)


def filled(docs: DataFrame, size: int = 12, most: int = 5000, key: str = "doc_id") -> DataFrame:
    """Groups of `size` lines that are not blank, of the first `most`; bounds are original lines."""
    numbered = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~_blank(s["x"]))
    rows = docs.select(key, F.slice(numbered, 1, most).alias("_n")).where(F.size("_n") > 0)
    rows = rows.select(key, "_n", F.explode(F.sequence(F.lit(0), F.size("_n") - 1, F.lit(size))).alias("_i"))
    part = rows.select(key, F.slice("_n", F.col("_i") + 1, size).alias("_p"))
    return part.select(key, F.col("_p")[0]["i"].alias("start_line"), F.element_at("_p", -1)["i"].alias("end_line"), F.array_join(F.transform("_p", lambda s: s["x"]), "\n").alias("content"))


def token_windows(docs: DataFrame, size: int = 1024, overlap: int = 20, key: str = "doc_id") -> DataFrame:
    """Windows of `size` tokens that share `overlap` tokens with the one before."""
    rows = docs.select(key, tokens(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    last = F.greatest(F.lit(0), F.size("_t") - overlap - 1)
    rows = rows.select(key, "_t", F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start_token"))
    return rows.select(key, "start_token", F.array_join(F.slice("_t", F.col("start_token") + 1, size), " ").alias("content"))


def islands(docs: DataFrame, size: int = 15, most: int = 5000, key: str = "doc_id") -> DataFrame:
    """Stretches of lines that are not blank, cut every `size` lines, packed in order while a block holds at most `size`.

    Packing ends once `most` lines are in blocks. Bounds are original lines; a text without filled lines has no blocks.
    """
    pair = lambda x, i: F.struct(i.alias("i"), x.alias("x"))
    numbered = F.filter(F.transform(lines(F.col("text")), pair), lambda s: ~_blank(s["x"]))
    rows = docs.select(key, numbered.alias("_n")).where(F.size("_n") > 0)
    # of each filled line: how many filled lines of its island end with it; a piece ends at `size` or before a gap
    run = F.aggregate("_n", F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.when((F.size(s) > 0) & (F.element_at("_n", F.size(s))["i"] == p["i"] - 1) & (F.element_at(s, -1) < size), F.element_at(s, -1) + 1).otherwise(1).cast("int"))))
    rows = rows.withColumn("_run", F.when(F.size("_n") > 0, run))
    ends = F.filter(F.transform("_run", lambda r, i: F.struct((i + 1).alias("to"), r.alias("n"), (F.coalesce(F.get("_run", i + 1), F.lit(1)) == 1).alias("end"))), lambda s: s["end"])
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("blocks"), F.lit(0).alias("total"))

    def packed(s, p):
        last = F.element_at(s["blocks"], -1)
        fits = (F.size(s["blocks"]) > 0) & (last["last"] - last["first"] + 1 + p["n"] <= size)
        one = F.struct((p["to"] - p["n"] + 1).cast("int").alias("first"), p["to"].cast("int").alias("last"))
        more = F.concat(F.slice(s["blocks"], 1, F.greatest(F.size(s["blocks"]) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), p["to"].cast("int").alias("last"))))
        return F.when(s["total"] >= most, s).otherwise(F.struct(F.when(fits, more).otherwise(F.concat(s["blocks"], F.array(one))).alias("blocks"), (s["total"] + p["n"]).alias("total")))

    rows = rows.withColumn("_b", F.explode(F.aggregate(ends, start, packed)["blocks"]))
    part = rows.select(key, F.slice("_n", F.col("_b.first"), F.col("_b.last") - F.col("_b.first") + 1).alias("_p"))
    return part.select(key, F.element_at("_p", 1)["i"].alias("start_line"), F.element_at("_p", -1)["i"].alias("end_line"), F.array_join(F.transform("_p", lambda s: s["x"]), "\n").alias("content"))


def recovered(text: Column, part: Column, after: int = 0) -> list[Column]:
    """start_line and end_line of a part of a text, from 0, by its first place behind `after` characters.

    Where it is not there as it is: the first line that holds its first line, and the last one that holds its last line,
    stripped; with neither, `after` // 80 and as many lines as it has.
    """
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    at = F.instr(F.substring(text, after + 1, 1 << 30), part)
    found = at + after
    start = breaks(F.substring(text, F.lit(1), found - 1))
    own, all_ = lines(part), lines(text)
    head, tail = F.trim(F.element_at(own, 1)), F.trim(F.element_at(own, -1))
    holds = lambda x, y: (F.length(y) > 0) & F.contains(x, y)
    first = F.array_position(F.transform(all_, lambda x: holds(x, head)), F.lit(True)) - 1
    last = F.size(all_) - F.array_position(F.reverse(F.transform(all_, lambda x: holds(x, tail))), F.lit(True))
    no_first, no_last = first < 0, last >= F.size(all_)
    n = F.size(own) - 1
    start = F.when(at > 0, start).when(~no_first, first).when(~no_last, F.greatest(F.lit(0), last - n)).otherwise(F.lit(after // 80))
    end = F.when(at > 0, breaks(F.substring(text, F.lit(1), found - 1)) + breaks(part)).when(~no_first & ~no_last, last).when(~no_first, first + n).when(~no_last, last).otherwise(F.lit(after // 80) + n)
    return [start.cast("int").alias("start_line"), end.cast("int").alias("end_line")]


def matching(paths: DataFrame, globs: list[str], col: str = "path") -> DataFrame:
    """Rows whose path a glob matches; a glob that matches none and has no leading * is tried again in any folder."""
    from siltstone.functions.text import glob_pattern

    known = {g: F.max(F.col(col).rlike(glob_pattern(g))) for g in globs}
    hit = paths.agg(*[m.alias(f"g{i}") for i, m in enumerate(known.values())]).first() if globs else ()
    used = [g if found or g.startswith("*") else f"**/{g}" for g, found in zip(globs, hit, strict=True)]
    match = F.lit(False)
    for g in used:
        match = match | F.col(col).rlike(glob_pattern(g))
    return paths.where(match)
