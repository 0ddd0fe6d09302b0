"""A training-data pipeline: each stage works on what its predecessor kept.

Stages in order: quality rules, near-duplicates by similarity, repeated byte strings,
benchmark decontamination, packing. All but the last return the columns of
documents. A document that loses all its bytes stays as an empty text; where a
removal cuts a character in two, the rest of that character goes as well.

Defined results: a null text fails the quality rules by its word count; null ids
pass through; of repeated rows one stays after near-duplicates; an empty table
gives an empty result; columns other than those of documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm._common import pick, stash, table
from quillmatch.llm.decontaminate import decontaminate
from quillmatch.llm.near_dup import near_keep
from quillmatch.llm.packing import digest, pack
from quillmatch.llm.quality import quality_filter
from quillmatch.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes from which a repeated string goes: nearly all passages of more than 50 words have as many.
REPEATED_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs, table(spark, sf_dir, "labels"), COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word Jaccard similarity of 0.8 or more."""
    return near_keep(docs, COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings; n_chars follows."""
    cut = suffix_dedup(docs, length=REPEATED_BYTES, carry=("lang", "source", "n_chars"), whole_chars=True)
    cut = cut.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source", F.col("n_chars").alias("before"), "n_removed")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("before")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontaminate(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return pick(docs, *COLUMNS).join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return digest(pack(docs))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeated strings", repeated_strings), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: hashed n-grams, MinHash bands, byte spans and the packing plan are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
