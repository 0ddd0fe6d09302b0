"""Token ids in training order: fixed-stride shards by a keyed permutation.

The ids of all documents of a task are laid end to end, each document closed by
an end id, and cut into sequences of ``length`` ids. Counts by task give each
sequence its number among all n. A keyed Feistel network over the next even
number of bits, walked until it lands below n, permutes 0..n-1: each sequence
has its slot in the training order without any sort by a random key, and the
order can be computed anew from the key alone.

Slots are dealt by range, ``per_shard`` to a shard, in one shuffle. A shard is
one binary file of records of equal size in slot order: a header (slot,
sequence, first and last document, ids that count, documents, which of the two
are null), ``length`` unsigned 16-bit little-endian ids, a line feed. So record
k of a shard begins at byte k times the stride, and a reader goes on from any
slot by seeking. Files appear under their names when Spark's committer renames
them; the shard's number is the folder's ``from=`` plus the number in the file's
name. Shards are written in ``rounds``, each with its share of the slots, so the
shuffle of one round is gone before the next and the disk holds less at once.

Sent to the driver and the tasks: one count for each task of the first step.

Defined results: a null text counts as empty and gives the end id alone; the
last sequence of a task is filled with ``pad`` and its true length is kept;
repeated rows and null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, drop_stash, freed, new_path, pick, record, stash, table
from ._tokens import TOKENIZER, encoder

LENGTH = 2048
END = 1
#: Records of a shard: about 16 MB, which a task reads at once.
PER_SHARD = 4096
ROUNDS = 2
KEY = 0x5EED
HEADER = np.dtype([("slot", "<i8"), ("sequence", "<i8"), ("first", "<i8"), ("last", "<i8"), ("n_tokens", "<i4"), ("n_docs", "<i4"), ("null", "u1"), ("spare", "V6")])
_SEQ = pa.schema([("chunk", pa.int64()), ("pos", pa.int64()), ("n_tokens", pa.int32()), ("n_docs", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("payload", pa.binary())])
_READ = pa.schema([("sequence_id", pa.int64()), ("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("n_tokens", pa.int32()), ("n_docs", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("payload", pa.binary())])
_READ_DDL = "sequence_id long, slot long, shard long, byte_offset long, n_tokens int, n_docs int, first_doc long, last_doc long, payload binary"
_SEQ_DDL = "chunk long, pos long, n_tokens int, n_docs int, first_doc long, last_doc long, payload binary"


def _round(x: np.ndarray, key: int, turn: int, mask: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x + np.uint64((key + turn * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h & np.uint64(mask)


def permute(index: np.ndarray, n: int, key: int = KEY, turns: int = 6, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers below n (or, with ``back``, numbers of slots): a bijection of 0..n-1."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = (1 << bits) - 1, np.uint64(bits)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & np.uint64(mask)
        for turn in reversed(range(turns)) if back else range(turns):
            if back:
                left, right = right ^ _round(left, key, turn, mask), left
            else:
                left, right = right, left ^ _round(right, key, turn, mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]  # walk the cycle until it is below n
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int = END, pad: int = 0) -> DataFrame:
    """Fixed-stride sequences of unsigned 16-bit ids, numbered within their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pos = TaskContext.get().partitionId(), 0
        code = encoder(tokenizer)
        rest, owners = np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64)
        keys: list = []

        def cut(upto: int, last: bool) -> Iterator[tuple]:
            nonlocal pos
            for k in range(0, upto, length):
                part, own = rest[k : k + length], owners[k : k + length]
                n = len(part)
                if last and n < length:
                    part = np.concatenate([part, np.full(length - n, pad, dtype="<u2")])
                yield chunk, pos, n, int(own[-1] - own[0] + 1), keys[own[0]], keys[own[-1]], part.tobytes()
                pos += 1

        for block in blocks(batches):
            ids, lens = code.block(block.column(1))
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("ids above 65,535 need a wider record")
            keys = keys[int(owners[0]) :] if len(owners) else []
            owners = owners - owners[0] if len(owners) else owners
            first = len(keys)
            keys += block.column(0).to_pylist()
            ends = np.cumsum(lens)
            rest = np.concatenate([rest, np.insert(ids, ends, end).astype("<u2")])
            owners = np.concatenate([owners, np.repeat(np.arange(first, len(keys)), lens + 1)])
            whole = len(rest) // length * length
            rows = list(cut(whole, False))
            rest, owners = rest[whole:], owners[whole:]
            if rows:
                yield record(_SEQ, *(list(c) for c in zip(*rows, strict=True)))
        if len(rest):
            yield record(_SEQ, *(list(c) for c in zip(*cut(len(rest), True), strict=True)))

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SEQ_DDL)


def stride(length: int = LENGTH) -> int:
    """Bytes of a record."""
    return HEADER.itemsize + 2 * length + 1


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str = TOKENIZER, end: int = END, rounds: int = ROUNDS) -> int:
    """Write all sequences in training order below ``path``; returns their number."""
    spark = docs.sparkSession
    own = stash(sequences(docs, length, tokenizer, end), "sequences")
    counts = sorted((r["chunk"], r["n"]) for r in own.groupBy("chunk").agg(F.count("*").alias("n")).collect())  # one row for each task
    n = sum(k for _, k in counts)
    chunks = np.array([c for c, _ in counts], dtype=np.int64)
    bases = np.cumsum([0, *(k for _, k in counts)])[:-1]
    at = spark.sparkContext.broadcast((chunks, bases))

    @F.pandas_udf("slot long, head binary")
    def deal(chunk: pd.Series, pos: pd.Series, n_tokens: pd.Series, n_docs: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        known, base = at.value
        head = np.zeros(len(chunk), dtype=HEADER)
        head["sequence"] = base[np.searchsorted(known, chunk.to_numpy())] + pos.to_numpy()
        head["slot"] = permute(head["sequence"], n, key)
        head["n_tokens"], head["n_docs"] = n_tokens, n_docs
        head["null"] = first.isna().to_numpy() + 2 * last.isna().to_numpy()
        for name, ids in (("first", first), ("last", last)):
            head[name] = [0 if x is None or x != x else int(x) for x in ids.astype(object)]
        size = HEADER.itemsize
        whole = head.tobytes()
        return pd.DataFrame({"slot": head["slot"], "head": [whole[k : k + size] for k in range(0, len(whole), size)]})

    whole = [F.coalesce(c, F.lit(0)) for c in ("n_tokens", "n_docs")]
    rows = own.select(deal("chunk", "pos", *whole, F.col("first_doc").cast("string"), F.col("last_doc").cast("string")).alias("d"), "payload").select("d.slot", "d.head", "payload")
    shards = -(-n // per_shard)
    step = -(-shards // rounds)
    for lo in range(0, shards, max(1, step)):
        hi = min(shards, lo + step)
        part = rows.where(F.col("slot").between(lo * per_shard, hi * per_shard - 1)).withColumn("part", F.expr(f"cast(slot div {per_shard} - {lo} as int)"))
        part = part.repartitionById(hi - lo, F.col("part")).sortWithinPartitions("slot").select(F.concat("head", "payload").cast("string"))
        with freed(spark):
            part.write.option("lineSep", "\n").option("compression", "none").text(f"{path}/from={lo}")
    drop_stash(own)
    return n


def read_shards(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The records from ``slot`` on: each shard in its order, whole shards before it not read."""
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                if len(data) % size:
                    raise ValueError(f"shard {shard} holds a broken record")
                data = data.reshape(-1, size)
                head = np.ascontiguousarray(data[:, : HEADER.itemsize]).view(HEADER).ravel()
                k = np.arange(max(0, slot - shard * per_shard), len(head))
                for own in np.split(k, range(1024, len(k), 1024)):
                    h = head[own]
                    if (h["slot"] != shard * per_shard + own).any():
                        raise ValueError(f"shard {shard} is not in order")
                    ids = [data[i, HEADER.itemsize : -1].tobytes() for i in own]
                    first, last = (pa.array(h[name], mask=h["null"] & bit > 0) for name, bit in (("first", 1), ("last", 2)))
                    yield record(_READ, h["sequence"], h["slot"], np.full(len(h), shard), own * size, h["n_tokens"], h["n_docs"], first, last, ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"from=(\d+)/part-(\d+)", 1).cast("long") + F.regexp_extract("path", r"from=(\d+)/part-(\d+)", 2).cast("long")
    return files.where(F.col("length") > 0).select(number.alias("shard"), "content").where(F.col("shard") >= slot // per_shard).mapInArrow(run, _READ_DDL)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sequence as it stands in the written shards."""
    path = new_path(spark, "shards")
    n = write_shards(table(spark, sf_dir, "documents"), path)
    own = read_shards(spark, path) if n else spark.createDataFrame([], _READ_DDL)
    return own.select("sequence_id", "slot", "shard", "byte_offset", "n_tokens", "n_docs", "first_doc", "last_doc", F.crc32("payload").alias("payload_crc32"))
