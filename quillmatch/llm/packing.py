"""Packing by non-negative least squares over a histogram of lengths.

Every document is encoded once; its whole windows stand alone and its rest has
a length below the window. The driver sees only the histogram of those rests:
at most ``window`` numbers. It enumerates shallow combinations (two or three
lengths that fill a window exactly), solves for their repeat counts by
non-negative least squares, rounds them down and keeps them within the
histogram. What is left is packed greedily: laid end to end, longest first, and
cut at the windows' borders. The last, partly filled window is cut at powers of
two, which need no padding.

A rest finds its place by its length and its rank among rests of that length;
ranks are counted inside each task and shifted by sums over tasks, so no group
of equal lengths ever meets in one task. One shuffle moves the ids.

Defined results: a null text counts as empty and is the end id alone; repeated
rows and null ids are packed like any others; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import blocks, pick, record, stash, table
from ._tokens import TOKENIZER, encoder

WINDOW = 2048
END = 1
#: Combinations that the second, exact solution keeps.
SUPPORT = 6000
_PIECES = pa.schema([("chunk", pa.int64()), ("len", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "chunk long, len int, rank long, doc_id long, start long, doc_tokens long, ids binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_OUT_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths, ascending, that sum to the window; 0 stands for none."""
    a = np.arange(0, window // 3 + 1)
    lo, hi = np.maximum(a, 1), (window - a) // 2
    first = np.repeat(a, np.maximum(0, hi - lo + 1))
    begin = np.repeat(np.cumsum(np.maximum(0, hi - lo + 1)) - np.maximum(0, hi - lo + 1), np.maximum(0, hi - lo + 1))
    second = np.arange(len(first)) - begin + np.repeat(lo, np.maximum(0, hi - lo + 1))
    return np.stack([first, second, window - first - second], axis=1)


def nnls(combos: np.ndarray, want: np.ndarray, rounds: int) -> np.ndarray:
    """Repeat counts x >= 0 that bring the used lengths near ``want``: multiplicative updates of least squares."""
    b = want.astype(float).copy()
    b[0] = 0.0
    pull = b[combos].sum(axis=1)
    x = np.where(pull > 0, pull / max(pull.sum(), 1e-9) * b.sum() / 2.5, 0.0)
    for _ in range(rounds):
        used = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=len(b))
        used[0] = 0.0
        x *= pull / np.maximum(used[combos].sum(axis=1), 1e-12)
    return x


@lru_cache(maxsize=4)
def _combos(window: int) -> np.ndarray:
    return combinations(window)


def plan(histogram: np.ndarray, window: int = WINDOW, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeat counts); no length is used more often than it occurs."""
    combos = _combos(window)
    combos = combos[(histogram[combos[:, 1]] > 0) & (histogram[combos[:, 2]] > 0) & ((combos[:, 0] == 0) | (histogram[combos[:, 0]] > 0))]
    if not len(combos):
        return combos, np.zeros(0, dtype=np.int64)
    x = nnls(combos, histogram, 40)
    top = np.argsort(-x, kind="stable")[:support]
    combos = combos[np.sort(top)]
    x = nnls(combos, histogram, 200)
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(combos), dtype=np.int64)
    order = np.argsort(-x, kind="stable")
    for limit in (np.floor(x).astype(np.int64), np.full(len(combos), np.iinfo(np.int64).max)):  # rounded, then what still fits
        for i in order:
            own: dict[int, int] = {}
            for n in combos[i].tolist():
                if n:
                    own[n] = own.get(n, 0) + 1
            most = min([int(limit[i]), *(int(left[n]) // k for n, k in own.items())])
            if most > 0:
                counts[i] += most
                for n, k in own.items():
                    left[n] -= k * most
    return combos[counts > 0], counts[counts > 0]


class Places:
    """Places of the rank-th piece of each length; built from the histogram alone."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        full = int(histogram[window])
        rests = histogram[:window].astype(np.int64)
        combos, counts = plan(rests, window)
        self.full = full
        base = full + np.cumsum(counts) - counts
        where, size = [], []
        for k in range(3):
            where.append(np.stack([combos[:, k], base, combos[:, :k].sum(axis=1), counts], axis=1))
        slots = np.concatenate(where)
        slots = slots[slots[:, 0] > 0]
        slots = slots[np.lexsort((slots[:, 2], slots[:, 1], slots[:, 0]))]
        self.length, self.base, self.offset, size = slots.T
        ends = np.cumsum(size)
        first = np.searchsorted(self.length, np.arange(window + 1))
        before = np.concatenate([[0], ends])[first]
        self.ends, self.before = ends, before  # slots of shorter lengths come before
        used = np.bincount(self.length, weights=size, minlength=window + 1).astype(np.int64)
        self.used = used
        rest = rests - used[:window]
        lengths = np.arange(window)
        later = (rest * lengths)[::-1].cumsum()[::-1]
        self.tape = np.concatenate([later[1:], [0]])  # longer pieces come first
        self.rest0 = full + int(counts.sum())
        self.total = int(later[0]) if window else 0

    def borders(self, lo: int, hi: int) -> list[int]:
        """Cuts of the tape that lie strictly between lo and hi."""
        w = self.window
        out = list(range((lo // w + 1) * w, hi, w))
        at = self.total // w * w
        left = self.total - at
        while left:
            step = 1 << (left.bit_length() - 1)
            at, left = at + step, left - step
            if lo < at < hi and at not in out:
                out.append(at)
        return sorted(out)

    def sequence(self, at: int) -> tuple[int, int]:
        """(sequence, offset) of a place on the tape."""
        w = self.window
        whole = self.total // w
        if at < whole * w:
            return self.rest0 + at // w, at % w
        k, begin, left = self.rest0 + whole, whole * w, self.total - whole * w
        while left:
            step = 1 << (left.bit_length() - 1)
            if at < begin + step:
                break
            k, begin, left = k + 1, begin + step, left - step
        return k, at - begin

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of each part."""
        if length == self.window:
            return [(0, length, rank, 0)]
        if rank < self.used[length]:
            slot = int(np.searchsorted(self.ends, self.before[length] + rank, side="right"))
            begin = int(self.ends[slot - 1]) if slot else 0
            return [(0, length, int(self.base[slot]) + int(self.before[length]) + rank - begin, int(self.offset[slot]))]
        lo = int(self.tape[length]) + (rank - int(self.used[length])) * length
        cuts = [lo, *self.borders(lo, lo + length), lo + length]
        return [(a - lo, b - a, *self.sequence(a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces(docs: DataFrame, window: int, tokenizer: str, end: int) -> DataFrame:
    """One row for each whole window or rest of a document, ranked among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        code = encoder(tokenizer)
        for block in blocks(batches):
            ids, lens = code.block(block.column(1))
            at, rows = 0, []
            for key, n in zip(block.column(0).to_pylist(), lens.tolist(), strict=True):
                own = np.append(ids[at : at + n], end).astype("<u4")
                at += n
                for k in range(0, n + 1, window):
                    part = own[k : k + window]
                    rows.append((chunk, len(part), int(seen[len(part)]), key, k, n + 1, part.tobytes()))
                    seen[len(part)] += 1
            yield record(_PIECES, *(list(c) for c in zip(*rows, strict=True)))

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES_DDL)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian) of each piece."""
    own = stash(pieces(docs, window, tokenizer, end), "pieces")
    sums = own.groupBy("len", "chunk").agg(F.count("*").alias("n"))
    bases = sums.select("len", "chunk", (F.sum("n").over(Window.partitionBy("len").orderBy("chunk")) - F.col("n")).alias("base"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in sums.groupBy("len").agg(F.sum("n").alias("n")).collect():  # window rows at most
        histogram[r["len"]] = r["n"]
    places = Places(histogram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "ids"):
            rows = []
            for length, rank, key, start, total, ids in zip(*(c.to_pylist() for c in block.columns), strict=True):
                for a, n, sequence, offset in places.place(length, rank):
                    rows.append((key, start + a, n, total, sequence, offset, ids[4 * a : 4 * (a + n)]))
            yield record(_OUT, *(list(c) for c in zip(*rows, strict=True)))

    placed = own.join(bases, ["len", "chunk"]).select("len", (F.col("base") + F.col("rank")).alias("rank"), "doc_id", "start", "doc_tokens", "ids")
    return placed.mapInArrow(run, _OUT_DDL)


def digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in the place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
