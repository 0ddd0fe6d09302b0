"""Helpers that the training-data operators share.

Tables are read through Spark only (paths may be on any store that Spark
knows), intermediate results are written as Parquet below the shared folder
named by ``spark.checkpoint.dir`` so that they survive a lost executor, and
Python code sees bounded blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import drop_stash, freed, new_path, shared_dir, stash

__all__ = ["blocks", "drop_stash", "freed", "new_path", "partitions", "pick", "ragged", "raw", "record", "shared_dir", "stash", "table"]

#: Text bytes that a Python block holds at most, apart from a single longer text.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever else the table holds.

    Other columns may clash with names that an operator makes, or differ from
    a wanted one in case only; both are left out by position.
    """
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a block has about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))])
        ends, start = size[1:], 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, size[start] + limit, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is the empty text."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len-1 of every run, concatenated."""
    lens = np.asarray(lens, dtype=np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begin = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - begin, lens)
