"""Scalar functions over text, paths and arrays, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "([a-z_][a-z0-9_]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Identifiers (A-Z lower-cased) of a text, in order; the text is folded once, no token by itself."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(IDENTIFIER), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def repo_of(instance: Column) -> Column:
    """owner__name-123 -> owner_name."""
    return F.regexp_replace(F.regexp_replace(instance, r"-\d+$", ""), "__", "_")


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def short_sha1(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def short_md5(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1, one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_test_path(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "[ _/]"), lambda x: F.startswith(x, F.lit("test")))


def squeezed(text: Column) -> Column:
    """Blank lines dropped, white space squeezed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n]+", " "))


def holds_unspaced(text: Column, part: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"[ \t\n]", "")
    return F.contains(bare(text), bare(part))


# What a message of each kind of error holds.
ERROR_CONTEXT = "context.*(length|token)|(length|token).*context|maximum context|max context"
ERROR_API = "timeout|timed out|429|500|502|503|504|rate limit|server error"


def error_kind(message: Column) -> Column:
    """CONTEXT_LENGTH_ERROR, LLM_API_ERROR or SYSTEM_ERROR by what a message holds, in this order."""
    low = F.lower(message)
    return F.when(low.rlike(f"(?s){ERROR_CONTEXT}"), "CONTEXT_LENGTH_ERROR").when(low.rlike(ERROR_API), "LLM_API_ERROR").otherwise("SYSTEM_ERROR")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncated(text: Column, most: int) -> Column:
    """The text without white space around it, cut to `most` characters with three dots; null is empty."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def repo_pattern(repo: str) -> str:
    """A path's part after the name of its repository, whose words are joined by _ or /."""
    return "(?i)" + "[_/]".join(re.escape(p) for p in repo.split("_")) + "/(.+)$"


def clean_path(path: Column, repo: str) -> Column:
    """The path within the repository; else the text after the last double slash; else the path."""
    pattern = repo_pattern(repo)
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(F.element_at(F.split(path, "//"), -1))


def glob_pattern(glob: str) -> str:
    """A regular expression for whole paths: ** crosses folders, * and ? don't, [..] is a set."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def embed_text(path: Column, start: Column, end: Column, content: Column) -> Column:
    """What is embedded of a block: a head with path and lines, unless the content has one."""
    head = F.concat(F.lit("file path: "), path, F.lit("\nlines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"))
    return F.when(F.startswith(content, F.lit("File:")), content).otherwise(F.concat(head, content))


def pooled(vectors: Column, mask: Column, how: str = "first_non_pad") -> Column:
    """One vector of an array of token vectors: cls, first_non_pad, last_token or mean over the mask."""
    if how == "cls":
        return F.get(vectors, F.lit(0))
    n = F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x)
    if how == "mean":
        zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
        add = lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y.cast("double") * p["m"])
        total = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), zero, add)
        return F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-6)))
    if how not in ("first_non_pad", "last_token"):
        raise ValueError(f"no such pooling: {how}")
    first = F.array_position(F.transform(mask, lambda m: m > 0), F.lit(True)) - 1
    return F.get(vectors, (F.greatest(first, F.lit(0)) if how == "first_non_pad" else F.greatest(n, F.lit(1)) - 1).cast("int"))
