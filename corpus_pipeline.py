"""A corpus pipeline over ``documents``: five stages, each one operator of ``codeloom.llm`` on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontam, langid, lines, simhash
from codeloom.llm.common import cut, drop_cut, row_ids, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of words no language is taken as found; with four languages a share is a quarter at least.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter (null and empty texts too) or without a leading language; a missing ``lang`` is
    filled in. Repeated rows stay."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))
    found = langid.predict(docs, langid.fit(docs.where(learn)), keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that resemble an earlier line; every document stays, ``n_chars`` follows its text. Null texts stay
    null; rows that repeat id and text are one document."""
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; so does one of repeated rows, and one
    of all texts without words."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts and items hold nothing."""
    rows = row_ids(docs.select(*COLUMNS))
    found = decontam.leaks(rows, table(spark, sf_dir, "benchmark")).select("row_id", F.col("doc_id").alias("_id")).distinct()
    # The hash alone could name another document too.
    return rows.join(found, (rows.row_id == found.row_id) & rows.doc_id.eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its bytes; null texts count as empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(docs, path, keep=["doc_id", "lang", "source", "text"])
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The stages train a model and follow links, which SQL cannot say; tests/llm/test_pipeline.py compares run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if held is not None:
            drop_cut(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
