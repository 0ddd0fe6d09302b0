"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most R bits have a common variant within
ceil(R/2) bits of each. Emitting all variants of 64 bits for R = 4 makes 2,081
rows for every fingerprint, some ten times the input's bytes, so the balls are
emitted in two steps that lose no link:

1. Of the two 32-bit halves, one differs in at most floor(R/2) bits
   (pigeonhole). Every distinct fingerprint emits the variants of each half
   within half of that, rounded up: 66 for R = 4. Rows meet on (half, variant).
   A bucket with two fingerprints gives one pair, which is verified on all 64
   bits.
2. Fingerprints in a bucket of three or more emit all variants of 64 bits within
   ceil(R/2). Two of a bucket link if one of them is within floor(R/2) of the
   variant: a star from the smallest such member replaces the pairs of the
   group, and each of its links differs in at most R bits by construction.

A link met in a crowded bucket of step 1 has both its ends in step 2; any other
is verified in step 1. Exact copies are one fingerprint throughout; crowds cost
rows in proportion to their members, never pairs.

Defined results: a null text counts as empty; texts without words share the
fingerprint zero, which links like any other; repeated rows give repeated
results; null ids never become a component's name unless it has no other (then
null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import blocks, drop_stash, partitions, pick, raw, record, stash, table
from ._graph import components

RADIUS = 4
#: The largest radius; its balls have 679,121 points.
MOST = 8
WORDS = 4
SEED = 42
#: A fingerprint is common if it has this share of the rows or more.
COMMON = 1 / 1000


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    import xxhash

    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(own) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none: zero."""
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, k1, k2 (a 128-bit key of id and text) and fp (the 64 bits as a signed long) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fps = np.array([fingerprint(t, words, seed) for t in raw(block.column(1))], dtype=np.uint64)
            yield record(schema, block.column(0), block.column(2), block.column(3), pa.array(fps.view(np.int64)))

    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.withColumns(_row_keys()).mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _row_keys() -> dict:
    return {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("simhash"), "text", "doc_id")}


def _masks(bits: range, most: int) -> list[int]:
    out = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _constant(masks: list[int]):
    """An array of longs that the optimiser folds into one literal."""
    return F.expr(f"transform(split('{','.join(map(str, masks))}', ','), x -> cast(x as bigint))")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): a graph with the components of all links between distinct fingerprints.

    ``fps`` has the column fp without repeats.
    """
    if not 0 <= radius <= MOST:
        raise ValueError(f"radius must be 0 to {MOST}")
    half, n = -(-(radius // 2) // 2), partitions(fps.sparkSession)
    # many rows come of each, and the few bytes would all go to one or two tasks; by another key, as Spark drops a repartition by the one it has
    fps = fps.repartition(n, F.xxhash64("fp"))
    low, high = _masks(range(32), half), _masks(range(32, 64), half)
    part = lambda k, masks: fps.select(
        F.lit(k).alias("half"), "fp", F.explode(_constant(masks)).alias("m")
    ).select("half", "fp", F.col("fp").bitwiseXOR(F.col("m")).bitwiseAND(F.lit(0xFFFFFFFF if k == 0 else -(1 << 32)).cast("long")).alias("key"))
    near = part(0, low).unionAll(part(1, high))
    sums = near.groupBy("half", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sums = stash(sums, "halves")
    pairs = sums.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    crowd = near.join(sums.where("n > 2").select("half", "key"), ["half", "key"], "left_semi").select("fp").distinct()
    every = _constant(_masks(range(64), -(-radius // 2)))
    ball = crowd.repartition(n, F.xxhash64("fp")).select("fp", F.explode(every).alias("m"))
    ball = ball.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"), (F.bit_count("m") > radius // 2).alias("far"))
    # a key has at most as many members as the ball has points
    center = F.first(F.struct("fp", "far")).over(Window.partitionBy("key").orderBy("far", "fp"))
    stars = ball.select(center.alias("u"), F.col("fp").alias("v")).where("not u.far and u.fp <> v").select("u.fp", "v").toDF("u", "v")
    edges = pairs.unionAll(stars).distinct()
    # the smallest neighbour below v takes over v's other links: in a crowd most of them become equal
    low = F.first("u").over(Window.partitionBy("v").orderBy("u"))
    return edges.select(low.alias("u"), F.when(F.col("u") == low, F.col("v")).otherwise(F.col("u")).alias("v")).distinct()


def _named(own: DataFrame, head, radius: int) -> DataFrame:
    """(fp, head, n, component_id): the least head of each fingerprint, its rows, and the least head of its component."""
    heads = own.groupBy("fp").agg(F.min(head).alias("head"), F.count("*").alias("n"))
    edges = stash(links(heads.select("fp"), radius), "links")
    linked = heads.join(components(edges).withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("label").agg(F.min("head").alias("component_id"))
    names = heads.join(linked.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", "head", "n", F.coalesce("component_id", "head").alias("component_id"))
    drop_stash(edges)
    return names


def simhash_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    own = stash(fingerprints(docs, words, seed), "fingerprints")
    names = stash(_named(own, F.col("doc_id"), radius).select("fp", "n", "component_id"), "names")
    total = names.agg(F.sum("n")).first()[0] or 0
    common = names.where(F.col("n") >= max(1, total * COMMON))  # at most 1 / COMMON rows
    cold = names.where(F.col("n") < max(1, total * COMMON))
    # rows of common fingerprints stay where they are
    hot = own.join(F.broadcast(common.drop("n")), "fp")
    rest = own.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(cold.drop("n"), "fp")
    return hot.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, columns: tuple[str, ...], words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """The named columns of one document of each group: that with the smallest id, of equal rows one."""
    own = stash(fingerprints(docs, words, seed), "fingerprints")
    heads = _named(own, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"), radius)
    kept = heads.where(F.col("head") == F.col("component_id")).select("head.k1", "head.k2")
    rows = pick(docs, *columns).withColumns(_row_keys()).join(kept, ["k1", "k2"], "left_semi")
    one = rows.withColumn("row", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("row = 1")
    return one.select(*columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
