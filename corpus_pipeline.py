"""A corpus pipeline of five stages over documents; each stage is written as Parquet and read again by the next.

Every stage works on all rows it is given and drops rows, not ids: an id may be null or repeat, with one text or several. Columns of any
name pass through, an empty table gives an empty one, and texts are read whole. SQL can't state these stages, so ORACLE_SQL is None; tests
hold each stage against a brute-force version of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import bpe, decontam, langid, line_dedup, simhash_dedup
from textloom.llm.native import free_name
from textloom.llm.queries import RANKS
from textloom.storage import stored, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those too far from every learnt language; repeated rows share a fate."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that so loses all but white space goes.

    Null and empty texts lose nothing and stay. n_chars follows the text where it changes.
    """
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    cut = line_dedup.deduplicated(docs, n_lines=n_lines, n_removed=n_removed)
    changed = F.col(n_removed) > 0
    left = cut.where(~changed | F.col("text").rlike(r"(?U)\S"))
    sized = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (left if sized is None else left.withColumn("n_chars", sized)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of the smallest id, null ids last. Texts without words are one group."""
    return simhash_dedup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds ten consecutive words of a benchmark item, or all words of a shorter one; null texts stay."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the bytes they decode to, of every row; a null text has neither ids nor bytes."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontaminate", decontaminate), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
