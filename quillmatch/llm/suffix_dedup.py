"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``length`` bytes that also starts
anywhere else, in its own text or another.

1. Each window of ``length`` bytes has an anchor: the leftmost smallest hash of
   its 64-byte strings, a function of the window's content alone. Windows with
   the same anchor place form one run, about every 170 bytes. A run's row holds
   the anchor's hash, a hash of the run's bytes and its place, no text.
2. Equal windows have equal anchor hashes. A run whose anchor hash occurs once
   is unique. Runs with equal content are repeated as a whole. What remains are
   runs of different content with one anchor hash: only their bytes, one copy
   of each content, are moved, grouped by anchor hash.
3. Groups are taken together up to a few MB. Their suffix array gives the
   transform; starting from the empty string, all intervals are extended
   backwards by one byte per level, breadth first. A boundary met first at level
   l has a common prefix of l. After level ``length - 1`` the boundaries that
   were never met are those with a common prefix of ``length`` or more, so the
   expansion stops there.
4. A group with more than ``crowd`` different contents is not brought together.
   Its windows are numbered by the distance from the anchor, and neighbours form
   blocks. The bytes that all windows of a block have in common meet by a 128-bit
   hash, counted before the shuffle; blocks whose common bytes stand in one
   content only hold no repeated window. The others are cut in four, down to
   single windows: rows follow the repeats, not the windows.
5. The spans return to their texts by a key made of id and text.

Defined results: a null text counts as empty; texts shorter than ``length``
stay whole; repeated rows are copies of each other, so all their windows go;
null ids pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, pick, ragged, raw, record, stash, table

LENGTH = 400
GRAM = 64
#: Contents of one anchor hash that meet in one transform.
CROWD = 2048
#: Bytes of a transform, apart from a single larger group.
TRANSFORM_BYTES = 1 << 20
#: Windows of a block at each level.
BLOCKS = (64, 16, 4, 1)
_POS = 24
_SEGMENT = 1 << 19

_RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("mh", pa.int64()), ("ch", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])
_RUNS_DDL = "k1 long, k2 long, mh long, ch long, lo long, n int"
_SLICES = pa.schema([("mh", pa.int64()), ("crowded", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("anchor", pa.int32()), ("bytes", pa.binary())])
_SLICES_DDL = "mh long, crowded boolean, k1 long, k2 long, lo long, anchor int, bytes binary"
_SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SPANS_DDL = "k1 long, k2 long, s long, e long"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place; too short ends are left out."""
    h, size, mul = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while size < gram:
        h = h[:-size] * np.uint64(mul) + h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        size, mul = 2 * size, mul * 0x5851F42D4C957F2D % (1 << 64) | 1
    return h


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each ``width`` neighbours."""
    n = len(keys)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor hash, content hash, first window, windows) of all runs, in parts."""
    import xxhash

    todo: list[tuple[int, int, bytes]] = []
    for i, t in enumerate(texts):  # a very long text in overlapping segments
        for at in range(0, max(0, len(t) - length) + 1, _SEGMENT):
            todo.append((i, at, t[at : at + _SEGMENT + length - 1]))
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for k, seg in enumerate(todo):
        if len(seg[2]) >= length:
            part.append(seg)
            size += len(seg[2])
        if not part or (size < _SEGMENT and k < len(todo) - 1):
            continue
        buffer = b"".join(s for _, _, s in part)
        lens = np.array([len(s) for _, _, s in part], dtype=np.int64)
        begins = np.cumsum(lens) - lens
        h = gram_hashes(np.frombuffer(buffer, dtype=np.uint8), gram)
        low = np.uint64((1 << _POS) - 1)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        smallest = sliding_min(keys, length - gram + 1)
        windows = lens - length + 1
        index = ragged(begins, windows)
        m = smallest[index]
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        n = np.diff(np.append(first, len(m)))
        lo = index[first]
        mh = h[(m[first] & low).astype(np.int64)].view(np.int64)
        digest = xxhash.xxh3_64_intdigest
        ch = np.array([digest(buffer[a:b]) for a, b in zip(lo.tolist(), (lo + n - 1 + length).tolist(), strict=True)], dtype=np.uint64).view(np.int64)
        owner = np.searchsorted(begins, lo, side="right") - 1
        number = np.array([i for i, _, _ in part], dtype=np.int64)[owner]
        start = lo - begins[owner] + np.array([at for _, at, _ in part], dtype=np.int64)[owner]
        yield number, mh, ch, start, n
        part, size = [], 0


def suffix_order(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their first ``depth`` symbols; nothing is compared beyond a place's end.

    symbols: bytes plus 1, and 0 at each end; ends: the end that follows each place.
    """
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(8, dtype=np.int64)])
    left = ends - np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = (key << 9) | np.where(left >= j, wide[j : n + j], 0)
    order = np.argsort(key)
    sorted_keys, slots, rank = key[order], np.arange(n), np.empty(n, dtype=np.int64)
    size = 7
    while True:  # slots: those whose place is not alone with its rank, in groups
        fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        own = order[slots]
        rank[own] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if size >= depth or not len(slots):
            return order
        own = order[slots]
        beyond = np.where(left[own] >= size, rank[np.minimum(own + size, n - 1)], 0)
        key = rank[own] * (n + 1) + beyond
        again = np.argsort(key)
        order[slots], sorted_keys = own[again], key[again]
        size *= 2


def repeated(slices: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether the string of ``length`` bytes from each place of the joined slices (an end after each) starts at two places or more."""
    lens = np.array([len(s) for s in slices], dtype=np.int64)
    stops = np.cumsum(lens + 1) - 1
    symbols = np.zeros(int(lens.sum()) + len(slices), dtype=np.int32)
    inside = np.ones(len(symbols), dtype=bool)
    inside[stops] = False
    symbols[inside] = np.frombuffer(b"".join(slices), dtype=np.uint8).astype(np.int32) + 1
    ends = np.repeat(stops, lens + 1)
    order = suffix_order(symbols, ends, length)
    n = len(symbols)
    before = np.zeros(n, dtype=np.int32)  # the transform; 0: nothing stands before
    before[1:] = symbols[:-1]
    bwt = before[order]
    back = np.empty(n, dtype=np.int64)  # where a place's predecessor stands in the order
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    heads = int((bwt == 0).sum())
    tails = len(slices)
    back += tails - heads  # suffixes that begin with an end come first
    met = np.zeros(n + 1, dtype=bool)
    met[[0, n, tails]] = True
    lo, hi = np.array([0, 0]), np.array([n - 1, tails - 1])
    for level in range(length):
        # the string of one end, not of none, is one symbol ahead of the empty string
        src_lo, src_hi = (lo[:1], hi[:1]) if level == 0 else (np.append(lo, 0), np.append(hi, tails - 1)) if level == 1 else (lo, hi)
        sizes = src_hi - src_lo + 1
        at = ragged(src_lo, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbol = bwt[at]
        some = symbol > 0
        to, owner, symbol = back[at[some]], owner[some], symbol[some]
        if not len(to):
            break
        rank = np.argsort(to, kind="stable")
        to, owner, symbol = to[rank], owner[rank], symbol[rank]
        fresh = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])
        first = np.flatnonzero(fresh)
        i, j = to[first], to[np.append(first[1:], len(to)) - 1]
        new = ~met[j + 1]
        met[j[new] + 1] = True
        lo, hi = i[new], j[new]
        if not len(lo) and level:
            break
    alone = met[:-1] & met[1:]
    out = np.zeros(n, dtype=bool)
    out[order] = ~alone
    out &= ends - np.arange(n) >= length
    return out


def anchor_place(part: bytes, mh: int, n: int, gram: int = GRAM) -> int:
    """Where the anchor with hash ``mh`` stands in the bytes of a run of ``n`` windows."""
    h = gram_hashes(np.frombuffer(part, dtype=np.uint8)[n - 1 :], gram).view(np.int64)
    return n - 1 + int(np.argmax(h == mh))


def _crowd_spans(contents: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that stand in two or more of the contents; contents: k1, k2, lo, anchor, bytes, without repeats."""
    spans = "k1", "k2", F.expr("lo + anchor - w").alias("s"), F.expr(f"lo + anchor - w + {length}").alias("e")
    live = contents.withColumn("w", F.lit(None).cast("long"))
    if not live.limit(1).count():
        return live.select(*spans)
    first, last = F.col("anchor") - (F.length("bytes") - length), F.col("anchor")  # distances of the run's windows from the anchor
    above = None
    for size in BLOCKS:
        lo, hi = (first, last) if above is None else (F.greatest(first, F.col("w")), F.least(last, F.col("w") + (above - 1)))
        grid = F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
        live = live.select("k1", "k2", "lo", "anchor", "bytes", grid.alias("g")).withColumn("w", F.col("g") * size).drop("g")
        core = F.substring("bytes", (F.col("anchor") - F.col("w") + 1).cast("int"), F.lit(length - size + 1))
        live = stash(live.withColumns({"c1": F.xxhash64("w", core), "c2": F.xxhash64(core, "w")}), "blocks")
        twice = live.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
        live, above = live.join(twice, ["c1", "c2"]).drop("c1", "c2"), size
    return live.select(*spans)


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order without overlaps or touching ends."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(fresh)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, s, e): spans of repeated strings; docs has k1, k2 and text. Spans may overlap; repeated rows have theirs once."""

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            k1, k2 = np.asarray(block.column(0)), np.asarray(block.column(1))
            for number, mh, ch, lo, n in runs(raw(block.column(2)), length, gram):
                yield record(_RUNS, k1[number], k2[number], mh, ch, lo, n.astype(np.int32))

    all_runs = stash(docs.select("k1", "k2", "text").mapInArrow(find_runs, _RUNS_DDL), "runs")
    own = F.xxhash64("k1", "k2", "lo")
    contents = all_runs.groupBy("mh", "ch").agg(F.count("*").alias("c"), F.min(own).alias("one"))
    anchors = contents.groupBy("mh").agg(F.count("*").alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    known = contents.join(anchors, "mh").select("mh", "ch", F.expr("c > 1").alias("whole"), F.expr("kinds > 1").alias("several"), F.expr(f"kinds > {crowd}").alias("crowded"), "one")
    found = all_runs.join(known, ["mh", "ch"]).select("k1", "k2", "lo", "n", "mh", "whole", "crowded", (F.col("several") & (own == F.col("one"))).alias("ship"))
    found = stash(found.where("whole or ship").distinct(), "found")  # repeated rows have the same runs

    ship = found.where("ship").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "mh", "crowded")).alias("runs"))  # runs of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for block in blocks(batches):
            for k1, k2, text, own_runs in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), raw(block.column(2)), block.column(3).to_pylist(), strict=True):
                if (k1, k2) == last:  # the merge join brings repeated rows after another
                    continue
                last, rows = (k1, k2), []
                for r in own_runs:
                    part = text[r["lo"] : r["lo"] + r["n"] - 1 + length]
                    rows.append((r["mh"], r["crowded"], k1, k2, r["lo"], anchor_place(part, r["mh"], r["n"], gram) if r["crowded"] else None, part))
                yield record(_SLICES, *(list(c) for c in zip(*rows, strict=True)))

    slices = stash(docs.hint("merge").join(ship, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(cut, _SLICES_DDL), "slices")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, last = 0, None

        def solve() -> Iterator[pa.RecordBatch]:
            if len(group) < 2:
                return
            hit = repeated([g[3] for g in group], length)
            lens = np.array([len(g[3]) for g in group], dtype=np.int64)
            begins = np.cumsum(lens + 1) - lens - 1
            at = np.flatnonzero(hit)
            if not len(at):
                return
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            s, e = at[first], at[np.append(first[1:], len(at)) - 1]
            owner = np.searchsorted(begins, s, side="right") - 1
            base = np.array([g[2] for g in group], dtype=np.int64)[owner] - begins[owner]
            yield record(_SPANS, [group[i][0] for i in owner], [group[i][1] for i in owner], s + base, e + base + length)

        for b in batches:
            for mh, k1, k2, lo, own_bytes in zip(*(b.column(c).to_pylist() for c in ("mh", "k1", "k2", "lo", "bytes")), strict=True):
                if mh != last and size > TRANSFORM_BYTES:
                    yield from solve()
                    group, size = [], 0
                last = mh
                group.append((k1, k2, lo, own_bytes))
                size += len(own_bytes)
        yield from solve()

    near = slices.where("not crowded").select("mh", "k1", "k2", "lo", "bytes").repartition("mh").sortWithinPartitions("mh").mapInArrow(transform, _SPANS_DDL)

    crowds = _crowd_spans(slices.where("crowded").select("k1", "k2", "lo", "anchor", "bytes"), length)
    whole = found.where("whole").select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    return whole.unionAll(near).unionAll(crowds)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, carry: tuple[str, ...] = (), whole_chars: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the kept bytes, and the columns ``carry`` of every document.

    With ``whole_chars``, the rest of a character that a removal has cut goes from the kept bytes as well.
    """
    if gram & (gram - 1) or gram >= length:
        raise ValueError("gram must be a power of two below length")
    own = pick(docs, "doc_id", "text", *carry).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    own = own.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("quill"), "text", "doc_id")})
    spans = repeated_spans(own, length, gram, crowd).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # spans of one text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            lists = block.column(2)
            flat = lists.flatten()
            at, sizes = 0, [0 if x is None else x for x in lists.value_lengths().to_pylist()]
            s_all, e_all = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            for text, k in zip(raw(block.column(1)), sizes, strict=True):
                if not k:
                    rows.append((len(text), 0, 0, text))
                    continue
                s, e = _joined(s_all[at : at + k], e_all[at : at + k])
                at += k
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                gone = len(text) - len(kept)
                rows.append((len(text), gone, len(s), kept.decode("utf-8", "ignore").encode() if whole_chars else kept))
            made = record(_OUT, block.column(0), *(list(c) for c in zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([*made.columns, *block.columns[3:]], names=[*made.schema.names, *carry])

    joined = own.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans", *carry)
    schema = T.StructType([*T._parse_datatype_string(_OUT_DDL).fields, *joined.select(*carry).schema.fields])
    return joined.mapInArrow(remove, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
