"""Levelled segments: assignment, build, compaction and the monolithic base.

A catalog is two DataFrames: documents(doc_id, shard_id, segment_id, status)
and segments(segment_id, shard_id, level, status, doc_count). Every function
returns new DataFrames; writing them is the caller's single-writer job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash
from .index import GROUP, Index

DOCS_PER_SEGMENT = 10
FAN_IN = 10
MAX_LEVEL = 4


def ready_for_etl(documents: DataFrame, files: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The next uploaded documents by id whose file exists."""
    own = documents.where("status = 'uploaded'")
    own = own if files is None else own.join(files.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.orderBy("doc_id").limit(limit)


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with their ``place``, from 0 in each group by ``order``, without bringing a group into one task.

    Rows are ranged and sorted; counts of each range and group, added up, give
    the place of a range's first row.
    """
    own = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    own = stash(own.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "placed")
    sums = own.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")  # a row for each range
    return own.join(sums.withColumn("_before", before), [*group, "_part"]).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_n", "_before")


def assign_level1(documents: DataFrame, per_segment: int = DOCS_PER_SEGMENT) -> DataFrame:
    """shard_id, batch, doc_id: documents waiting for a first segment in batches by id; the last may be partial."""
    own = documents.where("status = 'etl_ok' and segment_id is null")
    own = placed(own.select("shard_id", "doc_id"), ["shard_id"], ["doc_id"])
    return own.select("shard_id", F.floor(F.col("place") / per_segment).cast("long").alias("batch"), "doc_id")


def build_level1(documents: DataFrame, segments: DataFrame, per_segment: int = DOCS_PER_SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) after a build of all waiting documents."""
    batches = assign_level1(documents, per_segment)
    first = segments.agg(F.coalesce(F.max("segment_id"), F.lit(0)).alias("top"))
    made = batches.groupBy("shard_id", "batch").agg(F.count("*").alias("doc_count"))
    made = placed(made, [], ["shard_id", "batch"]).crossJoin(first).withColumn("segment_id", F.col("top") + F.col("place") + 1)  # first is one row
    fresh = made.select("segment_id", "shard_id", F.lit(1).alias("level"), F.lit("ready").alias("status"), "doc_count")
    to = batches.join(made.select("shard_id", "batch", F.col("segment_id").alias("made")), ["shard_id", "batch"]).select("doc_id", "made")
    docs = documents.join(to, "doc_id", "left").withColumns({"segment_id": F.coalesce("made", "segment_id"), "status": F.when(F.col("made").isNotNull(), "indexed").otherwise(F.col("status"))}).drop("made")
    return docs, segments.unionByName(fresh)


def compaction_plan(segments: DataFrame, level: int, fan_in: int = FAN_IN) -> DataFrame:
    """segment_id, shard_id, batch: full batches of the lowest ids among ready segments of a level."""
    own = segments.where((F.col("level") == level) & (F.col("status") == "ready"))
    sizes = own.groupBy("shard_id").agg(F.count("*").alias("all"))
    own = placed(own.select("segment_id", "shard_id"), ["shard_id"], ["segment_id"]).join(sizes, "shard_id").withColumn("batch", F.floor(F.col("place") / fan_in))
    return own.where((F.col("batch") + 1) * fan_in <= F.col("all")).select("segment_id", "shard_id", "batch")


def compact(documents: DataFrame, segments: DataFrame, level: int, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) after merging full batches of a level into the next."""
    own = compaction_plan(segments, level, fan_in)
    counts = segments.select("segment_id", "doc_count")
    made = own.join(counts, "segment_id").groupBy("shard_id", "batch").agg(F.sum("doc_count").alias("doc_count"))
    top = segments.agg(F.coalesce(F.max("segment_id"), F.lit(0)).alias("top"))
    made = placed(made, [], ["shard_id", "batch"]).crossJoin(top).withColumn("made", F.col("top") + F.col("place") + 1)  # top is one row
    to = own.join(made.select("shard_id", "batch", "made"), ["shard_id", "batch"]).select("segment_id", "made")
    docs = documents.join(to, "segment_id", "left").withColumn("segment_id", F.coalesce("made", "segment_id")).drop("made").select(*documents.columns)
    old = segments.join(to, "segment_id", "left").withColumn("status", F.when(F.col("made").isNotNull(), "merged").otherwise(F.col("status"))).drop("made")
    fresh = made.select(F.col("made").alias("segment_id"), "shard_id", F.lit(level + 1).alias("level"), F.lit("ready").alias("status"), "doc_count")
    return docs, old.select(*segments.columns).unionByName(fresh)


def move_postings(index: Index, to: DataFrame) -> Index:
    """An index after compaction: postings change their segment (``to``: segment_id, made); nothing is shingled anew."""
    def moved(df: DataFrame) -> DataFrame:
        return df.join(to, GROUP, "left").withColumn(GROUP, F.coalesce("made", GROUP)).select(*df.columns)

    return Index(moved(index.postings).distinct(), moved(index.meta))


def tick(documents: DataFrame, segments: DataFrame, max_level: int = 2, per_segment: int = DOCS_PER_SEGMENT, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """One worker round: ETL, first level, compaction up to ``max_level``."""
    waiting = ready_for_etl(documents).select("doc_id", F.lit(True).alias("go"))
    documents = documents.join(waiting, "doc_id", "left").withColumn("status", F.when(F.col("go"), "etl_ok").otherwise(F.col("status"))).drop("go")
    documents, segments = build_level1(documents, segments, per_segment)
    for level in range(1, max_level):
        documents, segments = compact(documents, segments, level, fan_in)
    return documents, segments


def searchable(segments: DataFrame, shard_id: int | None = None) -> DataFrame:
    """Ready segments of levels 1 to 4, highest level and newest first."""
    own = segments.where("status = 'ready' and level between 1 and 4")
    own = own if shard_id is None else own.where(F.col("shard_id") == shard_id)
    return own.orderBy(F.desc("level"), F.desc("segment_id"))


def first_levels(segments: DataFrame, max_levels: int) -> DataFrame:
    """Ready segments of the lowest ``max_levels`` distinct levels."""
    rank: Column = F.dense_rank().over(Window.orderBy("level"))
    return segments.where("status = 'ready'").withColumn("r", rank).where(F.col("r") <= max_levels).drop("r")


def pending_base(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents meant for the monolithic base that no base holds yet."""
    return documents.where("status = 'l5_uploaded'").join(indexed.select("doc_id").distinct(), "doc_id", "left_anti")


def extend_base(documents: DataFrame, base: DataFrame) -> DataFrame:
    """base(doc_id, base_id) with one more base of all pending documents; raises if there are none."""
    new = pending_base(documents, base)
    if new.limit(1).count() == 0:
        raise ValueError("no new documents")
    top = base.agg(F.coalesce(F.max("base_id"), F.lit(0)).alias("top"))
    return base.unionByName(new.select("doc_id").crossJoin(top).select("doc_id", (F.col("top") + 1).alias("base_id")))


def rebuild_base(documents: DataFrame, ids: list | None = None) -> DataFrame:
    """base(doc_id, base_id) of all documents meant for it as one base; an empty list means all."""
    own = documents.where("status = 'l5_uploaded'")
    own = own.where(F.col("doc_id").isin(ids)) if ids else own
    return own.select("doc_id", F.lit(1).alias("base_id"))
