"""The inverted index: postings, document frequencies, document metadata.

A corpus has doc_id and text. Documents below k tokens are rejected. Postings
are distinct pairs of a shingle's 64-bit key and a document; written indexes
are ranged by key, so a search prunes files by their key ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import spread

GROUP = "segment_id"


@dataclass
class Index:
    """postings(segment_id, key, doc_id) and meta(segment_id, doc_id, tok_len)."""

    postings: DataFrame
    meta: DataFrame

    def df(self) -> DataFrame:
        return self.postings.groupBy(GROUP, "key").agg(F.count("*").alias("df"))

    def cache(self) -> Index:
        self.postings.persist()
        self.meta.persist()
        return self


def tokenized(corpus: DataFrame) -> DataFrame:
    """segment_id, doc_id, words of every document; a corpus without segments is segment 0."""
    own = corpus if GROUP in corpus.columns else corpus.withColumn(GROUP, F.lit(0))
    return T.with_tokens(own.select(GROUP, "doc_id", "text"))


def postings_of(words: DataFrame, k: int = T.K) -> DataFrame:
    """segment_id, doc_id, tok_len, key: the distinct shingles of each document."""
    return words.where(F.size("words") >= k).select(GROUP, "doc_id", F.size("words").alias("tok_len"), F.explode(F.array_distinct(T.shingle_keys("words", k))).alias("key"))


def repeated_ids(corpus: DataFrame) -> DataFrame:
    """segment_id, doc_id of documents that stand in more than one row."""
    own = corpus if GROUP in corpus.columns else corpus.withColumn(GROUP, F.lit(0))
    return own.groupBy(GROUP, "doc_id").count().where("count > 1").select(GROUP, "doc_id")


def build(corpus: DataFrame, k: int = T.K) -> Index:
    """An index of the corpus; raises nothing on an empty one (see ``require_documents``).

    The postings of one row are distinct already, so only those of documents
    with several rows are shuffled to be made so; ids are counted for that.
    """
    words = tokenized(corpus)
    kept = words.where(F.size("words") >= k)
    meta = kept.groupBy(GROUP, "doc_id").agg(F.max(F.size("words")).alias("tok_len"))
    again = repeated_ids(corpus)
    if again.limit(1).count() == 0:
        return Index(postings_of(words, k).select(GROUP, "key", "doc_id"), meta)
    mark = again.select(F.col(GROUP).alias("_s"), F.col("doc_id").alias("_d"))
    same = F.col(GROUP).eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    single, several = (postings_of(words.join(mark, same, how), k).select(GROUP, "key", "doc_id") for how in ("left_anti", "left_semi"))
    return Index(single.unionByName(several.distinct()), meta)


def rejected(corpus: DataFrame, k: int = T.K) -> DataFrame:
    """Documents that the build leaves out, with their number of tokens."""
    own = tokenized(corpus).select("doc_id", F.size("words").alias("tok_len"))
    return own.where((F.col("tok_len") < k) | F.col("doc_id").isNull())


def require_documents(index: Index) -> Index:
    if index.meta.limit(1).count() == 0:
        raise ValueError("the corpus has no document with enough tokens")
    return index


def frequencies(postings: DataFrame, corpus: DataFrame, *by: str) -> DataFrame:
    """df of every key of a whole corpus. Nearly all keys are rare, so they are shuffled as they are: tables of each task's keys would only spill."""
    return postings.select(*by).repartition(spread(corpus), "key").groupBy(*by).agg(F.count("*").alias("df"))


def stats(corpus: DataFrame, k: int = T.K) -> DataFrame:
    """One row: documents, accepted, rejected, postings before and after dedup, distinct shingles."""
    words = tokenized(corpus)
    n = F.size("words")
    docs = words.agg(F.count("*").alias("lines_total"), F.sum((n >= k).cast("long")).alias("docs_ok"), F.sum((n < k).cast("long")).alias("docs_bad"), F.sum(F.when(n >= k, n - (k - 1)).otherwise(0).cast("long")).alias("pairs_before_dedup"))
    posts = frequencies(postings_of(words, k), corpus, "key").agg(F.count("*").alias("shingles"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df"))
    return docs.crossJoin(posts)  # one row each


def write(index: Index, path: str, files: int | None = None) -> None:
    """Postings ranged and sorted by key; metadata beside them. A segment that is written again replaces what it had."""
    spark = index.meta.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.postings.repartitionByRange(n, GROUP, "key").sortWithinPartitions(GROUP, "key", "doc_id").write.partitionBy(GROUP).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/postings")
    index.meta.write.partitionBy(GROUP).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/meta"))


def validate(index: Index) -> DataFrame:
    """One row of counts that are all zero in a sound index.

    Postings are dealt once, by document; their repetitions and their
    documents are counted where they lie. The segment is left out of the deal:
    Spark drops a constant one from the groups, and would shuffle again.
    """
    by = [GROUP, "doc_id"]
    posts = index.postings.select(*by, "key").repartition(spread(index.postings), "doc_id").groupBy(*by, "key").count()
    posts = posts.groupBy(*by).agg(F.sum("count").alias("rows"), F.sum((F.col("count") > 1).cast("long")).alias("twice"))
    known = F.col(GROUP).isNotNull() & F.col("doc_id").isNotNull()
    docs = index.meta.groupBy(*by).agg(F.sum((F.col("tok_len") < T.K).cast("long")).alias("short"), F.count("*").alias("n"))
    docs = docs.withColumn("more", F.col("n") - F.when(known, 1).otherwise(0))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return posts.join(docs, by, "full").agg(
        total("twice", "repeated_postings"), total(F.when(F.col("n").isNull(), F.col("rows")), "postings_without_document"),
        total("short", "short_documents"), total("more", "repeated_documents"),
    )
