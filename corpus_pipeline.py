"""From raw documents to packed sequences: language, quality, repeated lines, near duplicates, packing.

Each stage works on all that the one before has kept, and its decisions take effect.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.llm import language, line_dedup, near_duplicates, packing, quality_rules
from sparkforest.llm._util import Scratch, free

#: Least score of a document's language.
LANGUAGE_SCORE = 0.4


def beside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names (in any case) renamed, and the columns that bring them back: what an
    operator adds under such a name doesn't take the place of a column of the documents."""
    known = list(docs.columns)
    moved = {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = free(f"_own_{c}", [*known, *moved.values()])
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learnt, and clear; ``lang`` becomes the predicted one."""
    profiles = language.learn_profiles(docs)
    docs, own = beside(docs, "lang_pred", "score")
    named = language.identify(docs, profiles)
    kept = named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else x for c, x in zip(docs.columns, own)])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distances reject go. Null and empty texts go: they have no words.

    The verdicts stand beside a number of the row, which isn't a function of the row alone, so the plan can't push the
    filter below them and work each verdict out over again for each of its parts.
    """
    docs, own = beside(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
    row = free("_row", docs.columns)
    judged = quality_rules.judge(docs, quality_rules.References(docs)).withColumn(row, F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(row) >= 0)).select(*own)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of any length leave the texts; a document with no word left goes. ``n_chars`` follows the text."""
    docs, own = beside(docs, "n_removed")
    deduped = line_dedup.dedup_lines(docs)
    kept = deduped.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, own)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: of each group, one row stays, that with the smallest id. Null ids
    and texts without words stay."""
    return near_duplicates.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens. Null texts are the end id alone;
    repeated rows are packed each; no documents give no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Language profiles, sketches and the tokenizer aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result but the last a table in the shared folder. Columns of any name stay
    until the packing; rows that repeat an id or have none go through every stage by the rules that it states."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.store(docs)
    return docs
