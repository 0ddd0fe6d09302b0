"""Intermediate tables in the folder that the driver and all executors share.

They are written as Parquet below the folder named by ``spark.checkpoint.dir``
and read back, so they survive a lost executor and cut the lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of input for each task that shuffles its windows: some two million rows.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> int:
    """Shuffle partitions for rows that are many times df's: by the size that the planner gives for df's sources, the session's number at least."""
    n, leaves = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 50)  # the planner gives a huge number for what it does not know
    return max(n, -(-known // SPREAD_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is named, a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmatch-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
        _delete_on_exit(spark, found)
    return found.rstrip("/")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each has ended, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stash(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with freed(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no later job reads."""
    path, spark = getattr(df, "_stash_path", None), df.sparkSession
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
