"""Quality rules: simple counts plus a hashed n-gram likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. One
multinomial is fitted to trusted target texts (rows labelled as good), one to
the raw corpus: all documents. A document's score is the sum of the log ratios
of its n-grams divided by their number, so length does not matter, and it is
held against one fixed threshold: no sampling, every document gets a verdict.

The target is a bounded sample of labelled rows (``max_labelled`` of each class
in hash order); the corpus counts and the scores cover all documents. The
threshold is the largest that keeps all but ``max_loss`` of the good sample and
is at most the midpoint of the two class medians. Without both classes, only
the counts decide.

The corpus counts are summed in arrays inside each task and meet as at most one
row per bucket and task. What is sent to the tasks is one array of ``BUCKETS``
doubles, whatever the corpus.

Defined results: a null text counts as empty and fails by its word count; null
ids pass through and are never labelled; repeated rows give repeated results;
an empty table gives an empty result. An id labelled twice counts as good only
if all its labels are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, pick, raw, record, table

BUCKETS = 1 << 16
MAX_LABELLED = 4096
MAX_LOSS = 0.002
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACES, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.array([put(w, len(seen)) for w in words], dtype=np.int64), seen


def buckets(ids: np.ndarray, seen: dict[bytes, int], n: int = BUCKETS) -> np.ndarray:
    """Buckets of all unigrams, then of all bigrams."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, seen), dtype=np.uint64, count=len(seen))[ids] * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    two ^= two >> np.uint64(29)
    two *= np.uint64(0x9E3779B97F4A7C15)
    return (np.concatenate([h, two]) >> np.uint64(40)).astype(np.int64) % n


def repeat_words(ids: np.ndarray, n_distinct: int, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which stands in the text twice or more."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key, span = ids[:n], n_distinct
    for k in range(1, size):
        if span > 1 << 31:  # ranks keep the product below 2^63 in very long texts
            key, span = np.unique(key, return_inverse=True)[1].reshape(-1), n
        key, span = key * n_distinct + ids[k : n + k], span * n_distinct
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(ids), dtype=bool)
    for k in range(size):
        cover[k : n + k] |= again
    return int(cover.sum())


def text_rules(text: bytes) -> tuple[tuple[int, int, int, int, int, bool], np.ndarray, dict[bytes, int]]:
    words = text.split()
    ids, seen = word_ids(words)
    solid = text.translate(None, _SPACES)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = repeat_words(ids, len(seen))
    failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * len(words)
    return (len(words), chars, symbols, len(lines) - len(set(lines)), again, failed), ids, seen


def labelled_sample(labels: DataFrame, bound: int) -> dict[int, int]:
    """At most ``bound`` ids of each class, in the order of a hash of the id."""
    own = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("q"))
    out: dict[int, int] = {}
    for q in (0, 1):
        out |= {r["doc_id"]: q for r in own.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()}
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_loss: float = MAX_LOSS, n: int = BUCKETS) -> tuple[np.ndarray | None, float]:
    """(log ratio of each bucket, threshold); (None, -inf) if a class has no rows."""
    sample = labelled_sample(labels, max_labelled)
    if len(set(sample.values())) < 2:
        return None, float("-inf")
    schema = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])
    good = {k for k, q in sample.items() if q}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n), dtype=np.int64)
        for block in blocks(batches):
            for key, text in zip(block.column(0).to_pylist(), raw(block.column(1)), strict=True):
                own = np.bincount(buckets(*word_ids(text.split()), n), minlength=n) if len(text) > n else buckets(*word_ids(text.split()), n)
                for row in (0, 1) if key in good else (1,):
                    if len(text) > n:
                        sums[row] += own
                    else:
                        np.add.at(sums[row], own, 1)
        at = np.flatnonzero(sums[1])
        yield record(schema, at.astype(np.int32), sums[0][at], sums[1][at])

    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = own.mapInArrow(count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    sums = np.zeros((2, n))
    for r in rows:  # BUCKETS rows at most
        sums[:, r["bucket"]] = r["target"], r["raw"]
    p = (sums + 1.0) / (sums.sum(axis=1, keepdims=True) + n)
    ratio = np.log(p[0] / p[1])

    ids = docs.sparkSession.createDataFrame([(k,) for k in sample], "doc_id long")
    few = own.join(F.broadcast(ids), "doc_id", "left_semi")  # max_labelled ids of each class
    found = few.mapInArrow(_scorer(ratio, float("-inf"), n), DDL).select("doc_id", "llr").collect()
    by = [sorted(r["llr"] for r in found if sample[r["doc_id"]] == q) for q in (0, 1)]
    if not all(by):
        return None, float("-inf")
    middle = (by[0][len(by[0]) // 2] + by[1][len(by[1]) // 2]) / 2
    return ratio, min(by[1][int(max_loss * len(by[1]))] - 1e-9, middle)


def llr(ratio: np.ndarray, ids: np.ndarray, seen: dict[bytes, int], n: int) -> float:
    """Mean log ratio of a text's n-grams; 0 for none."""
    own = buckets(ids, seen, n)
    return float(ratio[own].sum() / len(own)) if len(own) else 0.0


def _scorer(ratio: np.ndarray | None, threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for text in raw(block.column(1)):
                base, ids, seen = text_rules(text)
                score = 0.0 if ratio is None else llr(ratio, ids, seen, n)
                rows.append((*base, not base[5] and score >= threshold, score))
            yield record(OUT, block.column(0), *(list(c) for c in zip(*rows, strict=True)))

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_loss: float = MAX_LOSS, n: int = BUCKETS) -> DataFrame:
    """Counts, length-normalised log ratio and verdict of every document.

    ``docs`` has doc_id and text, ``labels`` has doc_id and quality (0 or 1).
    """
    ratio, threshold = fit(docs, labels, max_labelled, max_loss, n)
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_scorer(ratio, threshold, n), DDL)


def quality_filter(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], max_labelled: int = MAX_LABELLED, max_loss: float = MAX_LOSS, n: int = BUCKETS) -> DataFrame:
    """The named columns of the documents that the rules keep: a filter without a shuffle."""
    ratio, threshold = fit(docs, labels, max_labelled, max_loss, n)
    own = pick(docs, *columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            kept = []
            for text in raw(block.column(at)):
                base, ids, seen = text_rules(text)
                kept.append(not base[5] and (ratio is None or llr(ratio, ids, seen, n) >= threshold))
            yield block.filter(pa.array(kept, pa.bool_()))

    return own.mapInArrow(run, own.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
