"""Hashes, sketches and shard numbers.

Engine-internal keys use ``xxhash64``. The functions here give the values that
other tools of this kind store: FNV-1a with its own basis, SimHash over 128
bits, MinHash with banded buckets, and the two shard numbers.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import stash
from ._udf import arrow

FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211
_M64 = (1 << 64) - 1


def fnv1a64_py(data: bytes, seed: int = FNV_BASIS) -> int:
    h = seed
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & _M64
    return h


def fnv1a64_batch(items: list[bytes], seed: int = FNV_BASIS) -> np.ndarray:
    """Hashes of many byte strings: one vector step for each byte position."""
    lens = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    order = np.argsort(-lens, kind="stable")
    data = np.frombuffer(b"".join(items), dtype=np.uint8)
    begins = (np.cumsum(lens) - lens)[order]
    live = lens[order]
    h = np.full(len(items), seed, dtype=np.uint64)
    for k in range(int(live[0]) if len(live) else 0):
        n = int(np.searchsorted(-live, -k, side="left"))
        h[:n] = (h[:n] ^ data[begins[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@arrow("long")
def fnv1a64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of a string's UTF-8 as a signed long; null for null."""
    for s in batches:
        some = s.notna()
        out = pd.array([pd.NA] * len(s), dtype="Int64")
        out[some.to_numpy()] = fnv1a64_batch([t.encode() for t in s[some]]).view(np.int64)
        yield pd.Series(out)


def fnv1a64_sql(text: Column) -> Column:
    """The same without Python: 32-bit halves keep every product below 2^63."""
    prime = 435
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        low = x * prime
        return F.struct((state["hi"] * prime + F.shiftleft(x, 8) + F.shiftright(low, 32)).bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    codes = F.transform(F.sequence(F.lit(1), F.length(F.encode(text, "UTF-8"))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def sha1_digits(text: Column) -> Column:
    """First 8 bytes of SHA-1 as an unsigned number in decimal digits."""
    return F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16), 16, 10)


def sha1_key(text: Column) -> Column:
    """The same number as decimal(20,0)."""
    return sha1_digits(text).cast("decimal(20,0)")


def shard_md5(key: Column, n: int) -> Column:
    """Shard number from the first 8 bytes of MD5."""
    return (F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def shard_crc32(key: Column, n: int) -> Column:
    """Shard number from CRC-32."""
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(n)).cast("int")


def owner_key(university: Column, faculty: Column, group: Column) -> Column:
    """The three owner fields joined by bars; missing fields are empty."""
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (university, faculty, group)])


def hamming128(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def _votes(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0) >= len(hashes)).tobytes(), "big")


@arrow("struct<hi: long, lo: long>")
def simhash128(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """128-bit SimHash of an array of tokens, each with its multiplicity; a tie gives a one bit."""
    for s in batches:
        his, los = [], []
        for words in s:
            raw = [] if words is None else [w.encode() for w in words]
            hi, lo = (_votes(fnv1a64_batch(raw, seed)) if raw else _M64 for seed in (FNV_PRIME, FNV_BASIS))
            his.append(hi - (1 << 64) if hi >> 63 else hi)
            los.append(lo - (1 << 64) if lo >> 63 else lo)
        yield pd.DataFrame({"hi": his, "lo": los})


@arrow("string")
def simhash128_sha1(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same voting over the first 16 bytes of SHA-1, as 32 hex digits."""
    for s in batches:
        out = []
        for words in s:
            raw = b"".join(hashlib.sha1(w.encode()).digest()[:16] for w in (() if words is None else words))
            bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16), axis=1).astype(np.int64)
            out.append(np.packbits(2 * bits.sum(axis=0) >= len(bits)).tobytes().hex())
        yield pd.Series(out)


# --- MinHash -------------------------------------------------------------------


@lru_cache(maxsize=8)
def minhash_constants(k: int = 128, seed: int = 1337) -> tuple[np.ndarray, np.ndarray]:
    """k odd multipliers, then k addends: the low 32 of 64 bits drawn from a fixed generator."""
    rng = random.Random(seed)
    low = [rng.getrandbits(64) & 0xFFFFFFFF for _ in range(2 * k)]
    return np.array(low[:k], dtype=np.uint64) | np.uint64(1), np.array(low[k:], dtype=np.uint64)


def minhash_py(keys: np.ndarray, k: int = 128, seed: int = 1337) -> np.ndarray:
    """k minima of mixed 64-bit keys; the empty set gives all ones."""
    a, b = minhash_constants(k, seed)
    if not len(keys):
        return np.full(k, 0xFFFFFFFF, dtype=np.uint64)
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint64)
    for part in np.array_split(keys, -(-len(keys) // 8192)):
        v = part[:, None] * a + b
        out = np.minimum(out, ((v ^ (v >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).min(axis=0))
    return out


def minhash_udf(k: int = 128, seed: int = 1337):
    @arrow("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: minhash_py(np.asarray([] if x is None else x, dtype=np.int64).view(np.uint64), k, seed).astype(np.int64).tolist())

    return run


def band_keys(signature: Column, rows: int = 4, k: int = 128) -> Column:
    """Bucket of each band: first 8 bytes of SHA-1 over its rows as 4-byte words."""
    if k % rows:
        raise ValueError("rows must divide k")
    word = lambda x: F.lpad(F.hex(x), 8, "0")
    band = lambda b: F.substring(F.sha1(F.unhex(F.array_join(F.transform(F.slice(signature, b * rows + 1, rows), word), ""))), 1, 16)
    return F.transform(F.sequence(F.lit(0), F.lit(k // rows - 1)), lambda b: F.struct(b.alias("band"), band(b).alias("bucket")))


def lsh_candidates(signed: DataFrame, rows: int = 4, k: int = 128) -> DataFrame:
    """(doc, head): documents that share a bucket with the smallest document of that bucket.

    ``signed`` has doc_id and signature, which are computed once. A bucket gives a star, never all its pairs.
    """
    signed = stash(signed.select("doc_id", "signature"), "signatures")
    spots = signed.select("doc_id", F.explode(band_keys(F.col("signature"), rows, k)).alias("b")).select("doc_id", "b.band", "b.bucket")
    heads = spots.groupBy("band", "bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return spots.join(heads, ["band", "bucket"]).where("doc_id <> head").select("doc_id", "head").distinct()
