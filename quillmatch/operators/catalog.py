"""Catalog tables: schemas, status reports, task queue, error log, reset.

A table is a folder of versions. A change of rows writes the next version aside
and renames it into place, so a reader sees the old state or the new one and a
crash loses neither; older versions go afterwards. Rewrites need a single
writer; tasks and errors are logs that any number of workers append to. A task's
state is its newest row, and a worker owns a task once it has created the file
of that name, which only one can.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id long, external_id string, shard_id int, segment_id long, status string, simhash_hi long, simhash_lo long, title string, student_name string, university string, faculty string, group_name string, created_at timestamp, updated_at timestamp, last_checked_at timestamp",
    "segments": "segment_id long, shard_id int, level int, status string, path string, doc_count long, shingle_count long, size_bytes long, created_at timestamp, last_compacted_at timestamp, last_access_at timestamp",
    "segment_docs": "segment_id long, doc_id long, shard_id int",
    "index_errors": "error_id string, doc_id long, segment_id long, stage string, error_code string, message string, payload string, created_at timestamp, retry_count int",
    "index_tasks": "task_id string, task_type string, status string, payload string, attempts int, last_error string, created_at timestamp, started_at timestamp, finished_at timestamp, changed_at timestamp",
}
DOCUMENT_STATES = ("uploaded", "etl_ok", "indexed", "l5_uploaded", "error")
SEGMENT_STATES = ("building", "ready", "merged", "error", "retired")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> int | None:
        """The newest version of a table."""
        p, fs = self._fs(f"{self.root}/{name}")
        found = [int(x.getPath().getName()[1:]) for x in fs.listStatus(p)] if fs.exists(p) else []
        return max(found, default=None)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        rows = self.spark.createDataFrame([], SCHEMAS[name]) if version is None else self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name, version))
        return latest(rows, "task_id", "changed_at") if name == "index_tasks" else rows

    def append(self, name: str, rows: DataFrame) -> None:
        self._shaped(name, rows).write.mode("append").parquet(self._path(name, self._version(name) or 0))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the next version aside, rename it into place, then drop older ones."""
        before = self._version(name)
        fresh = f"{self.root}/_{name}-{uuid.uuid4().hex}"
        self._shaped(name, rows).write.parquet(fresh)
        (new, fs), (parent, _) = self._fs(fresh), self._fs(f"{self.root}/{name}")
        fs.mkdirs(parent)
        after = 0 if before is None else before + 1
        if not fs.rename(new, self._fs(self._path(name, after))[0]):
            raise OSError(f"version {after} of {name} could not be put in place")
        for version in range(after - 1, -1, -1):
            old, _ = self._fs(self._path(name, version))
            if not fs.exists(old):
                break
            fs.delete(old, True)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    # --- tasks and errors

    def enqueue(self, task_type: str, payload: dict) -> str:
        task = uuid.uuid4().hex
        self.append("index_tasks", self.spark.createDataFrame([(task, task_type, "pending", json.dumps(payload), 0, _now(), _now())], "task_id string, task_type string, status string, payload string, attempts int, created_at timestamp, changed_at timestamp"))
        return task

    def next_task(self) -> dict | None:
        """Claim and start the oldest pending task that no other worker has claimed."""
        for row in self.table("index_tasks").where("status = 'pending'").orderBy("created_at", "task_id").limit(64).collect():
            claim, fs = self._fs(f"{self.root}/_claims/{row['task_id']}-{row['attempts']}")
            if fs.createNewFile(claim):
                self._update(row["task_id"], {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": F.lit(_now())})
                return row.asDict()
        return None

    def finish_task(self, task_id: str, error: str | None = None) -> None:
        self._update(task_id, {"status": F.lit("failed" if error else "done"), "last_error": F.lit(error[:2000] if error else None), "finished_at": F.lit(_now())})

    def _update(self, task_id: str, changes: dict) -> None:
        """Append the task's new state."""
        row = self.table("index_tasks").where(F.col("task_id") == task_id)
        self.append("index_tasks", row.withColumns(changes | {"changed_at": F.lit(_now())}).coalesce(1))

    def touch_segments(self, ids: list[int]) -> None:
        """Note that the segments have been searched."""
        rows = self.table("segments")
        self.replace("segments", rows.withColumn("last_access_at", F.when(F.col("segment_id").isin(ids), F.lit(_now())).otherwise(F.col("last_access_at"))))

    def retire_segments(self, ids: list[int]) -> None:
        """Take segments out of searches; their files stay."""
        rows = self.table("segments")
        self.replace("segments", rows.withColumn("status", F.when(F.col("segment_id").isin(ids), F.lit("retired")).otherwise(F.col("status"))))

    def log_error(self, stage: str, code: str, message: str, doc_id: int | None = None, segment_id: int | None = None, payload: dict | None = None) -> None:
        row = [(uuid.uuid4().hex, doc_id, segment_id, stage[:16], code[:64], message, json.dumps(payload or {}), _now(), 0)]
        self.append("index_errors", self.spark.createDataFrame(row, SCHEMAS["index_errors"]))

    def reset(self, shard_id: int | None = None, confirm: bool = False) -> dict[str, int]:
        """Delete all rows, or those of one shard; returns how many."""
        if not confirm:
            raise ValueError("a reset needs confirm=True")
        gone = {}
        for name in SCHEMAS:
            rows = self.table(name)
            if shard_id is not None and "shard_id" not in rows.columns:
                continue
            drop = rows if shard_id is None else rows.where(F.col("shard_id") == shard_id)
            gone[name] = drop.count()
            self.replace(name, rows.limit(0) if shard_id is None else rows.where(~F.col("shard_id").eqNullSafe(shard_id)))
        return gone

    def status(self) -> DataFrame:
        return status(self.table("documents"), self.table("segments"))


def status(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: waiting documents, ready segments of each level, documents of the monolithic base."""
    ready = lambda n: F.coalesce(F.sum(((F.col("status") == "ready") & (F.col("level") == n)).cast("long")), F.lit(0)).alias(f"ready_l{n}")
    docs = documents.agg(F.coalesce(F.sum((F.col("status") == "uploaded").cast("long")), F.lit(0)).alias("level0_docs"), F.coalesce(F.sum((F.col("status") == "l5_uploaded").cast("long")), F.lit(0)).alias("l5_docs"))
    return docs.crossJoin(segments.agg(*[ready(n) for n in (1, 2, 3, 4)]))  # one row each


def bases(base: DataFrame) -> DataFrame:
    """base_id and number of documents of each monolithic base."""
    return base.groupBy("base_id").agg(F.count("*").alias("docs"))


def shards_with_ready(segments: DataFrame, level: int, at_least: int) -> DataFrame:
    """Shards that have enough ready segments of a level."""
    own = segments.where((F.col("level") == level) & (F.col("status") == "ready"))
    return own.groupBy("shard_id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def documents_of(documents: DataFrame, segment_docs: DataFrame, segment_id: int) -> DataFrame:
    return documents.join(segment_docs.where(F.col("segment_id") == segment_id).select("doc_id"), "doc_id")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r")
