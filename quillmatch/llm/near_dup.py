"""Near-duplicates by similarity: SimHash balls and MinHash bands propose pairs, Jaccard decides.

A text is the set of its windows of ``words`` words (a shorter text is one
window, a text without words the empty set). Texts with equal sets are one node
throughout. Its SimHash fingerprint is taken over the set, and fingerprints
within ``radius`` bits meet by the balls of simhash_dedup: each component of
their links is a bucket. At 0.8 most fingerprints differ in more bits, so each
of ``BANDS`` bands gives a bucket as well: it hashes ``ROWS`` minima, and two
sets of Jaccard similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. No pair counts before its Jaccard
similarity has been computed from the texts themselves.

Pairs of a bucket come in two steps:

1. In rounds, one member of a bucket's largest component meets all members of
   its other components. The first is the one that shares most buckets with
   others, which in a crowd of near copies is closest to their original. Rounds
   end when the pairs between components are few for each row, or after
   ``ROUNDS``.
2. Members outside the largest component of a bucket meet the whole bucket,
   in pairs of blocks: a task holds two blocks of bounded size and counts the
   common windows of all their sets; only links that join components leave it.

So no link between components of a bucket is lost, whatever ``ROUNDS`` is. A
crowd whose members are alike costs pairs in proportion to its members. In a
crowd of texts that share buckets and are not alike, step 2 makes a row for each
member and block, not for each pair; its comparisons still grow with the
members outside the largest component times the bucket, and it is not cut short.

Defined results: a null text counts as empty; repeated rows give one row; null
ids are kept only where a group has no other; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, drop_stash, pick, raw, record, stash
from ._graph import components
from .simhash_dedup import RADIUS, _row_keys, links, majority

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SEED = 42
#: Rounds in which buckets meet one of their members; on two tables with crowds the first found 0.89 and 0.97 of the links, two more 0.03 and 0.02.
ROUNDS = 1
#: Pairs for each row that end the rounds.
FEW = 2
#: Windows of a block of texts that meets another block.
BLOCK = 1 << 16
#: Sets of a side, and hashes, that a task compares at once.
_SIDE, _COLUMNS = 256, 1 << 14
#: Windows whose minima are taken at once.
_STEP = 2048


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct windows."""
    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(own) - words + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(own)) - 1 :].tolist(), strict=True)], dtype=np.uint64))


@lru_cache(maxsize=4)
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def band_hashes(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One signed 64-bit key of each band; keys of different bands differ."""
    import xxhash

    a, b = _mixers(bands * rows)
    least = np.full(bands * rows, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(own), _STEP):
        least = np.minimum(least, (own[k : k + _STEP, None] * a + b).min(axis=0))
    wide = least.astype("<u8").tobytes()
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(wide[8 * rows * i : 8 * rows * (i + 1)], i)) >> 63 else x for i in range(bands)]


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, k1, k2 (a 128-bit key of id and text), s (a key of the set), size, fp (the fingerprint as a signed long) and bands of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block in blocks(batches):
            sets = [shingles(t, words) for t in raw(block.column(1))]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64)
            fps = np.array([majority(x) for x in sets], dtype=np.uint64)
            yield record(schema, block.column(0), block.column(2), block.column(3), pa.array(keys.view(np.int64)), [len(x) for x in sets], pa.array(fps.view(np.int64)), [band_hashes(x) for x in sets])

    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.withColumns(_row_keys()).mapInArrow(run, "doc_id long, k1 long, k2 long, s long, size long, fp long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (u, v) whose texts have at least the similarity."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for block in blocks(batches, "tv"):
            keep = []
            for key, a, b in zip(block.column(0).to_pylist(), raw(block.column(2)), raw(block.column(3)), strict=True):
                if last[0] != key:
                    last = [key, shingles(a, words)]
                x, y = last[1], shingles(b, words)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            keep = np.flatnonzero(keep)
            yield record(schema, block.column(0).take(pa.array(keep)), block.column(1).take(pa.array(keep)))

    met = pairs.join(texts.select(F.col("s").alias("v"), F.col("text").alias("tv")), "v").join(texts.select(F.col("s").alias("u"), F.col("text").alias("tu")), "u")
    return met.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common hashes of each set on the left and each on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for own in (left, right):
        sides.append((np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    at = []
    for hashes, row in sides:
        col = np.minimum(np.searchsorted(both, hashes), max(0, len(both) - 1))
        hit = both[col] == hashes if len(both) else np.zeros(len(hashes), dtype=bool)
        at.append((row[hit], col[hit]))
    for k in range(0, len(both), _COLUMNS):
        grids = []
        for own, (row, col) in zip((left, right), at, strict=True):
            here = (col >= k) & (col < k + _COLUMNS)
            grid = np.zeros((len(own), min(_COLUMNS, len(both) - k)), dtype=np.float32)
            grid[row[here], col[here] - k] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _apart(rest: DataFrame, texts: DataFrame, words: int, least: float, limit: int = BLOCK) -> DataFrame:
    """(u, v): labels of similar components of a bucket, found block by block.

    ``rest`` has s, size, key, label and own, the largest component of the
    bucket. Members outside it meet all members of the bucket; what goes to one
    task is a pair of blocks of about ``limit`` windows each, and only links
    come back.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    outer = F.col("label") != F.col("own")
    windows = rest.groupBy("key").agg(F.sum(F.when(outer, F.col("size"))).alias("few"), F.sum("size").alias("all"))
    count = lambda c: F.ceil((F.col(c) + 1) / limit)
    rest = rest.join(windows.select("key", count("few").alias("n0"), count("all").alias("n1")), "key")
    side = lambda k, mine, its: F.struct(F.lit(k).alias("side"), F.pmod(F.xxhash64("s", F.lit(k)), F.col(mine)).alias("mine"), F.sequence(F.lit(0).cast("long"), F.col(its) - 1).alias("its"))
    rows = rest.select("s", "label", "key", F.explode(F.when(outer, F.array(side(0, "n0", "n1"), side(1, "n1", "n0"))).otherwise(F.array(side(1, "n1", "n0")))).alias("x"))
    rows = rows.select("s", "label", "key", F.col("x.side").alias("side"), F.col("x.mine").alias("mine"), F.explode("x.its").alias("its"))
    group = F.when(F.col("side") == 0, F.xxhash64("key", "mine", "its")).otherwise(F.xxhash64("key", "its", "mine"))
    rows = rows.select(group.alias("g"), "side", "s", "label").join(texts, "s").select("g", "side", "s", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[list, list] = ([], [])
        last = None

        def solve() -> Iterator[pa.RecordBatch]:
            left, right = group
            for i in range(0, len(left), _SIDE):
                for j in range(0, len(right), _SIDE):
                    a, b = left[i : i + _SIDE], right[j : j + _SIDE]
                    both = _overlaps([x[2] for x in a], [x[2] for x in b])
                    size = np.array([len(x[2]) for x in a])[:, None] + np.array([len(x[2]) for x in b])[None, :]
                    keep = (both >= least * (size - both) - 1e-6) & (np.array([x[1] for x in a])[:, None] != np.array([x[1] for x in b])[None, :])
                    up: dict = {}

                    def top(x: int) -> int:
                        while up.setdefault(x, x) != x:
                            up[x] = x = up[up[x]]
                        return x

                    links = []
                    for u, v in zip(*np.nonzero(keep), strict=True):  # a link between components that are joined already adds nothing
                        x, y = top(a[u][1]), top(b[v][1])
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            links.append((a[u][1], b[v][1]))
                    if links:
                        yield record(schema, *(list(c) for c in zip(*links, strict=True)))

        for block in blocks(batches):
            for g, k, s, label, text in zip(*(block.column(c).to_pylist() for c in range(4)), raw(block.column(4)), strict=True):
                if g != last:
                    yield from solve()
                    group, last = ([], []), g
                group[k].append((s, label, shingles(text, words)))
        yield from solve()

    return rows.repartition("g").sortWithinPartitions("g", "side", "s").mapInArrow(run, "u long, v long").distinct()


def _balls(nodes: DataFrame, radius: int) -> DataFrame:
    """(s, size, key): nodes whose fingerprints are joined by links of at most ``radius`` bits have the same key."""
    edges = stash(links(nodes.select("fp").distinct(), radius), "balls")
    named = components(edges).withColumnRenamed("node", "fp")
    drop_stash(edges)
    return nodes.join(named, "fp", "left").select("s", "size", F.xxhash64(F.lit("ball"), F.coalesce("label", "fp")).alias("key"))


def groups(nodes: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY, rounds: int = ROUNDS, radius: int = RADIUS) -> DataFrame:
    """(s, label): the component of each node that shares a bucket, by verified links.

    ``nodes`` has s without repeats, size, fp and bands; ``texts`` has a text for each s.
    """
    spots = nodes.select("s", "size", F.explode("bands").alias("key")).unionAll(_balls(nodes, radius))
    # only what shares a bucket goes on
    shared = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    spots = stash(spots.join(shared, "key").select("s", "size", "key", "n"), "spots")
    texts = stash(texts.join(spots.select("s").distinct(), "s", "left_semi").select("s", "text"), "texts")
    now = stash(spots.join(spots.groupBy("s").agg(F.sum("n").alias("met")), "s").select("s", "size", "key", "met", F.col("s").alias("label")), "named")
    drop_stash(spots)
    tried: list[DataFrame] = []
    found: list[DataFrame] = []

    def verify(pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        for t in tried:
            pairs = pairs.join(t, ["u", "v"], "left_anti")
        tried.append(stash(pairs, "pairs"))
        found.append(stash(_verified(tried[-1], texts, words, least), "links"))

    def opened(now: DataFrame, turn: int) -> DataFrame:
        """The buckets with several components: a member of the largest, and the pairs of different components."""
        order = F.struct("met", "s") if not turn else F.struct(F.xxhash64("s", F.lit(turn)), "s")
        parts = now.groupBy("key", "label").agg(F.count("*").alias("n"), F.max_by("s", order).alias("x"))
        size = F.struct("n", "label")
        own = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.max_by("x", size).alias("x"), F.max_by("label", size).alias("own"), F.sum(F.col("n") * F.col("n")).alias("sq"))
        return own.where("kinds > 1").select("key", "x", "own", "all", ((F.col("all") * F.col("all") - F.col("sq")) / 2).alias("cross"))

    for turn in range(rounds):
        heads = stash(opened(now, turn), "open")
        left = heads.agg(F.sum("cross").alias("pairs"), F.sum("all").alias("rows")).first()
        if turn and (left["pairs"] or 0) <= FEW * (left["rows"] or 0):
            break
        if turn == 0 and not left["rows"]:
            break
        verify(now.join(heads.select("key", "x", "own"), "key").where("label <> own").select("x", F.col("s").alias("y")))
        named = components(_all(found)).withColumnRenamed("node", "s")
        again = stash(now.drop("label").join(named, "s", "left").select("s", "size", "key", "met", F.coalesce("label", "s").alias("label")), "named")
        drop_stash(now)
        drop_stash(heads)
        now = again
    # what is still apart: components are joined by their labels
    joined = stash(_apart(now.join(opened(now, 0).select("key", "own"), "key"), texts, words, least), "links")
    last = components(joined).select(F.col("node").alias("label"), F.col("label").alias("last"))
    out = stash(now.select("s", "label").distinct().join(last, "label", "left").select("s", F.coalesce("last", "label").alias("label")), "groups")
    for own in (*tried, *found, joined, texts, now):
        drop_stash(own)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def near_keep(docs: DataFrame, columns: tuple[str, ...], words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The named columns of one document of each group: that with the smallest id, of equal rows one."""
    own = stash(sketches(docs, words), "sketches")
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    heads = stash(own.groupBy("s").agg(F.min(head).alias("head"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "heads")
    drop_stash(own)
    keyed = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(_row_keys()).select("k1", "k2", "text")
    texts = keyed.join(heads.select("s", F.col("head.k1").alias("k1"), F.col("head.k2").alias("k2")), ["k1", "k2"]).select("s", "text").dropDuplicates(["s"])
    labels = groups(heads.select("s", "size", "fp", "bands"), texts, words, least, radius=radius)
    linked = heads.select("s", "head").join(labels, "s")
    gone = linked.join(linked.groupBy("label").agg(F.min("head").alias("least")), "label").where(F.col("head") != F.col("least")).select("s")
    kept = heads.join(gone, "s", "left_anti").select("head.k1", "head.k2")
    rows = pick(docs, *columns).withColumns(_row_keys()).join(kept, ["k1", "k2"], "left_semi")
    one = rows.withColumn("row", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("row = 1")
    return one.select(*columns)
