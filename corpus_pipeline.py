"""The corpus pipeline: five stages over documents, each one of the operators of siltstone.llm.

Every stage keeps the columns of documents, whatever their names; only the last returns pieces. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import ship
from siltstone.llm import language, lines, minhash, mixing, packing
from siltstone.llm._base import cut, small_batches, table


def _prepared(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts and texts without letters go.

    Filters are learned from the rows with text and lang. Repeated rows and rows without doc_id, lang or source are
    judged by their text like others; rows of equal text are kept or go together. Where nothing can be learned
    (no lang at all), no language can be told.
    """
    _prepared(spark)
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name of docs clashes with one of the operator
    renamed = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")]))
    out = language.identify(renamed, language.fit(docs)).where("lang_pred != 'und'")
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of runs of lines, in order of doc_id (null first), then of a hash of the text.

    Null text stays null, a text of which all lines go becomes empty; rows that repeat doc_id and text are one place.
    """
    _prepared(spark)
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Empty and null texts are near nothing and stay, rows without doc_id too. A doc_id that goes does so with all its rows.
    """
    _prepared(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    own = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*own).join(gone, F.col(own[docs.columns.index("doc_id")]) == F.col("doc_id"), "left_anti")
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: whole as often as whole epochs take them, then what the last one takes.

    Null source is a source, the last. A text without words stays once if its source is taken whole. Repeated rows count each.
    """
    _prepared(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the offset of each; null and empty texts are one piece of the id 0.

    Repeated rows, of which the mix makes many, are documents of their own, as are rows without doc_id.
    """
    _prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_to_targets), ("packing", pack)]

#: Learned models, pseudorandom draws and tokenizers are beyond SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table documents, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
