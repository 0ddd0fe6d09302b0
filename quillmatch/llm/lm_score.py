"""Language-model scores by context-tree weighting over bytes.

The next byte is coded as eight binary decisions. Each decision has one node at
every depth: the d bytes before (d = 0..depth) and the bits already known. A
node holds a Krichevsky-Trofimov estimate from its counts; the weight of a node
against the subtree of longer contexts below it follows from their block
probabilities, one half a priori each. The estimate of a byte mixes all depths
along its context.

Counts are gathered in tasks as n-grams of depth + 1 bytes, which determine all
nodes, and summed over the whole training corpus. All n-grams are kept, in a
table that grows with the corpus and is never sent anywhere whole:

1. Contexts with the same two last bytes form one subtree; a group of n-grams is
   bounded by their other bytes, whatever the corpus. Each is weighted from its
   leaves up, and the sums for the nodes of depth one (65,280 at most) go to the
   driver, which weights the top.
2. The top (two bytes, 65,536 costs at most) goes to all tasks. Each subtree is
   walked down again and gives the code length of each n-gram of the documents,
   seen in training or not.
3. The ``frequent`` n-grams with the highest counts are looked up in the task
   that scores a text; all others meet their code lengths by a shuffle. So
   ``frequent`` changes no score.

A byte never seen after a context shares the probability that the context
leaves to unseen bytes, in proportion to the next shorter context; this makes
the sum over all bytes one. A text is its bytes with A-Z lower-cased, closed by
a zero byte, after zero bytes.

The base score is a unigram model with 0.1 added to each count. The ``frequent``
words with the highest counts are looked up in the task as well, all others by a
shuffle.

Defined results: a null text counts as empty: one end token; a null id has the
text "" and is held out; ``held_out`` depends on the id alone, so repeated rows
get repeated results and count as often as they occur; an empty table gives an
empty result; without training texts all counts are zero and the model is
uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, drop_stash, pick, ragged, raw, record, stash, table

DEPTH = 4
#: N-grams, and words, that are looked up in the tasks: 12 and 16 bytes each.
FREQUENT_GRAMS = 1 << 20
FREQUENT = 1 << 18
ADD = 0.1
_FLUSH = 300_000
#: N-grams of whole subtrees that are weighted at once.
_SUBTREES = 1 << 18


# --- the model ---------------------------------------------------------------


def text_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(an n-gram of depth + 1 bytes for each byte and each end, their number by text)."""
    lens = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(bytes(depth) + t.lower() + b"\0" for t in texts), dtype=np.uint8)
    grams = np.zeros(len(data) - depth, dtype=np.int64)
    for k in range(depth + 1):
        grams = (grams << 8) | data[k : len(data) - depth + k]
    begins = np.cumsum(lens + depth) - lens - depth
    return grams[ragged(begins, lens)], lens


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers by Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the KT block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one order for decision ``j``: context and known bits, their counts, and where each n-gram stands."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, j: int):
        self.node, self.at = np.unique(keys >> (8 - j), return_inverse=True)
        self.bit = (keys >> (7 - j)) & 1
        total = np.bincount(self.at, weights=counts, minlength=len(self.node))
        self.ones = np.bincount(self.at, weights=counts * self.bit, minlength=len(self.node))
        self.zeros = total - self.ones
        self.kt = (self.ones + 0.5) / (total + 1.0)
        self.above = self.node & ((1 << (8 * max(0, order - 1) + j)) - 1)  # the node with one context byte less


def orders(grams: np.ndarray, counts: np.ndarray, depth: int, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams of order d, their counts) for d = first..depth, from those of order ``depth``."""
    out = []
    for d in range(first, depth + 1):
        keys, at = np.unique(grams & ((1 << (8 * d + 8)) - 1), return_inverse=True)
        out.append((keys, np.bincount(at, weights=counts, minlength=len(keys))))
    return out


class Tree:
    """Nodes of the orders first, first + 1, ...; ``tables`` has (n-grams, counts) of each."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], first: int):
        self.tables, self.first = tables, first

    def levels(self, j: int) -> list[Level]:
        return [Level(keys, counts, self.first + i, j) for i, (keys, counts) in enumerate(self.tables)]

    @staticmethod
    def up(levels: list[Level], below: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(log block probabilities of the first order, each order's own share); below: those under the last order, if any."""
        shares = [np.ones(len(x.node)) for x in levels]
        log_pw = np.zeros(0)
        for i in reversed(range(len(levels))):
            own = log_kt(levels[i].zeros, levels[i].ones)
            if i + 1 < len(levels):
                below = np.bincount(np.searchsorted(levels[i].node, levels[i + 1].above), weights=log_pw, minlength=len(own))
            if below is None:
                log_pw = own
                continue
            shares[i] = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            log_pw = math.log(0.5) + np.logaddexp(own, below)
        return log_pw, shares

    @staticmethod
    def down(levels: list[Level], shares: list[np.ndarray], done: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(bits of the decision by n-gram of each order, what is mixed and what is left below the last order)."""
        out = []
        for i, x in enumerate(levels):
            if i:
                up = np.searchsorted(levels[i - 1].node, x.above)
                done, left = done[up], left[up]
            p1 = done + left * x.kt
            out.append(-np.log2(np.where(x.bit == 1, p1[x.at], 1 - p1[x.at])))
            done, left = done + left * shares[i] * x.kt, left * (1 - shares[i])
        return out, done, left


def _leave(keys: np.ndarray, cost: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, bits of leaving each for the next shorter one); shorter: the costs of the same bytes there."""
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    own = np.maximum(1 - np.bincount(at, weights=np.exp2(-cost), minlength=len(contexts)), 1e-9)
    other = np.maximum(1 - np.bincount(at, weights=np.exp2(-shorter), minlength=len(contexts)), 1e-9)
    return contexts, np.log2(other) - np.log2(own)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted keys, whether they hold what is wanted)."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def subtree_sums(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decision, node of depth one, sum of the log block probabilities of whole subtrees below it)."""
    tree = Tree(orders(grams, counts, depth, 2), 2)
    out = []
    for j in range(8):
        levels = tree.levels(j)
        log_pw, _ = tree.up(levels)
        nodes, at = np.unique(levels[0].above, return_inverse=True)
        out.append((np.full(len(nodes), j), nodes, np.bincount(at, weights=log_pw, minlength=len(nodes))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Top:
    """The orders 0 and 1, from the counts of all pairs of bytes and the sums of all subtrees."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]):
        tree = Tree(orders(pairs, counts, 1, 0), 0)
        cost = [np.zeros(len(k)) for k, _ in tree.tables]
        self.states = []
        for j in range(8):
            levels = tree.levels(j)
            own = sums[0] == j
            at, hit = _find(levels[1].node, sums[1][own])
            below = np.bincount(at[hit], weights=sums[2][own][hit], minlength=len(levels[1].node))
            _, shares = tree.up(levels, below)
            bits, done, left = tree.down(levels, shares, np.zeros(len(levels[0].node)), np.ones(len(levels[0].node)))
            cost = [a + b for a, b in zip(cost, bits, strict=True)]
            self.states.append((levels[1].node, done, left))
        seen = tree.tables[0][0]
        self.zero = np.full(256, 8.0)
        self.zero[seen] = cost[0]
        if 0 < len(seen) < 256:
            rest = np.ones(256, dtype=bool)
            rest[seen] = False
            self.zero[rest] = -math.log2(max(1 - np.exp2(-cost[0]).sum(), 1e-9) / rest.sum())
        one = tree.tables[1][0]
        contexts, leave = _leave(one, cost[1], self.zero[one & 255])
        back = np.zeros(256)
        back[contexts] = leave
        self.one = (back[:, None] + self.zero[None, :]).ravel()  # of each pair of bytes
        self.one[one] = cost[1]


def subtree_costs(grams: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """Code length in bits of the last byte of each n-gram of whole subtrees; a count of zero: not seen in training."""
    some = counts > 0
    tree = Tree(orders(grams[some], counts[some], depth, 2), 2)
    cost = [np.zeros(len(k)) for k, _ in tree.tables]
    for j in range(8):
        levels = tree.levels(j)
        _, shares = tree.up(levels)
        node, done, left = top.states[j]
        at, _ = _find(node, levels[0].above)
        bits, _, _ = tree.down(levels, shares, done[at], left[at])
        cost = [a + b for a, b in zip(cost, bits, strict=True)]
    out, todo, back = np.zeros(len(grams)), np.arange(len(grams)), []
    for i, (keys, _) in enumerate(tree.tables):
        short = keys & ((1 << (8 * (i + 2))) - 1)
        back.append(_leave(keys, cost[i], top.one[short] if i == 0 else cost[i - 1][np.searchsorted(tree.tables[i - 1][0], short)]))
    for i in reversed(range(len(cost))):
        own = grams[todo] & ((1 << (8 * (i + 3))) - 1)
        at, hit = _find(tree.tables[i][0], own)
        out[todo[hit]] += cost[i][at[hit]]
        todo, own = todo[~hit], own[~hit]
        at, hit = _find(back[i][0], own >> 8)
        out[todo[hit]] += back[i][1][at[hit]]
    out[todo] += top.one[grams[todo] & 0xFFFF]
    return out


class Lookup:
    """Values of 64-bit keys: two hashed tables, then what found no free place in order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given, self.tables = (keys, values), None

    def _build(self) -> None:
        """At the first use, so that only keys and values are sent."""
        (keys, values), self.tables = self.given, []
        for mul in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(1, (2 * len(keys)).bit_length())
            shift = np.uint64(64 - bits)
            slot = self._slot(keys, mul, shift)
            used, first = np.unique(slot, return_index=True)
            table, own = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=values.dtype)
            table[used], own[used] = keys[first], values[first]
            self.tables.append((mul, shift, table, own))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _slot(keys: np.ndarray, mul: int, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(mul)) >> shift).astype(np.int64)

    def get(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether they are known); keys are not negative."""
        if self.tables is None:
            self._build()
        out, todo = np.zeros(len(wanted)), np.arange(len(wanted))
        for mul, shift, table, own in self.tables:
            slot = self._slot(wanted[todo], mul, shift)
            hit = table[slot] == wanted[todo]
            out[todo[hit]] = own[slot[hit]]
            todo = todo[~hit]
        at, hit = _find(self.keys, wanted[todo])
        out[todo[hit]] = self.values[at[hit]]
        known = np.ones(len(wanted), dtype=bool)
        known[todo[~hit]] = False
        return out, known


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _merge(a: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([a[0], keys])
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate([a[1], counts])[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def gram_table(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, m): the n-grams of all texts, how often they stand in training texts and in all; docs has text and held_out."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        have = [none, none]  # training texts, others

        def flush() -> Iterator[pa.RecordBatch]:
            for k, (keys, n) in enumerate(have):
                if len(keys):
                    yield record(schema, keys, n if k == 0 else np.zeros(len(n), dtype=np.int64), n)

        for block in blocks(batches):
            texts, out = raw(block.column(0)), block.column(1).to_pylist()
            for k in (0, 1):
                own = [t for t, o in zip(texts, out, strict=True) if o == bool(k)]
                if own:
                    have[k] = _merge(have[k], *np.unique(text_grams(own, depth)[0], return_counts=True))
            if len(have[0][0]) + len(have[1][0]) > 4 * _FLUSH:
                yield from flush()
                have = [none, none]
        yield from flush()

    sums = docs.select("text", "held_out").mapInArrow(count, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return stash(sums, "grams")


def _subtrees(table: DataFrame, run, schema: str) -> DataFrame:
    """Calls run(columns of whole subtrees) for the rows of (gram, ...)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            own = [np.asarray(c) for c in b.columns]
            while size + len(own[0]) > _SUBTREES:  # what comes before the last subtree's begin is whole
                held.append(own)
                own = [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
                group = (own[0] >> 8) & 0xFFFF
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield run(*(c[:cut] for c in own))
                    own = [c[cut:] for c in own]
                else:
                    break
            held.append(own)
            size += len(own[0])
        if size:
            yield run(*(np.concatenate(c) for c in zip(*held, strict=True)))

    group = F.expr("shiftright(gram, 8) & 65535")
    return table.withColumn("group", group).repartition("group").sortWithinPartitions("group", "gram").drop("group").mapInArrow(walk, schema)


def gram_costs(table: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, m, cost): code lengths of the last bytes of all n-grams of the table."""
    spark = table.sparkSession
    sums_schema = pa.schema([("j", pa.int32()), ("node", pa.int64()), ("log_pw", pa.float64())])
    cost_schema = pa.schema([("gram", pa.int64()), ("m", pa.int64()), ("cost", pa.float32())])

    def up(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        j, node, log_pw = subtree_sums(grams, n, depth)
        return record(sums_schema, j.astype(np.int32), node, log_pw)

    seen = table.where("n > 0")
    sums = _subtrees(seen.select("gram", "n"), up, "j int, node long, log_pw double").groupBy("j", "node").agg(F.sum("log_pw").alias("log_pw")).toArrow()
    pairs = seen.groupBy(F.expr("gram & 65535").alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(np.asarray(pairs["pair"]))
    top = spark.sparkContext.broadcast(Top(np.asarray(pairs["pair"])[order], np.asarray(pairs["n"])[order].astype(float), tuple(np.asarray(sums[c]) for c in ("j", "node", "log_pw"))))

    def down(grams: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return record(cost_schema, grams, m, subtree_costs(grams, n, depth, top.value).astype(np.float32))

    return stash(_subtrees(table.select("gram", "n", "m"), down, "gram long, m long, cost float"), "costs")


def most_frequent(costs: DataFrame, bound: int) -> tuple[int, pa.Table]:
    """(least count, the n-grams with that count or more): at most ``bound`` of them, whole classes of counts."""
    steps = costs.groupBy(F.floor(4 * F.log2("m")).alias("b")).agg(F.count("*").alias("k"), F.min("m").alias("m")).collect()  # a few hundred rows
    total, least = 0, 1 << 62
    for r in sorted(steps, reverse=True):
        total += r["k"]
        if total > bound:
            break
        least = r["m"]
    return least, costs.where(F.col("m") >= least).select("gram", "cost").toArrow()


# --- scores ------------------------------------------------------------------

_WORDS = pa.schema([("h", pa.int64()), ("c", pa.int64())])
_COUNTED = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int32())]))
_DOCS = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()), ("n_bytes", pa.int64()), ("rare", _COUNTED), ("grams", _COUNTED)])
_DOCS_DDL = "k long, doc_id long, held_out boolean, n_tokens long, known long, base double, bits double, n_bytes long, rare array<struct<h:long,tf:int>>, grams array<struct<h:long,tf:int>>"


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word at each place, hash of each number, words by text)."""
    import xxhash

    seen: dict[bytes, int] = {}
    put = seen.setdefault
    lens, ids = [], []
    for t in texts:
        words = t.lower().split()
        lens.append(len(words))
        ids += [put(w, len(seen)) for w in words]
    digest = xxhash.xxh64_intdigest
    return np.array(ids, dtype=np.int64), np.fromiter(map(digest, seen), dtype=np.uint64, count=len(seen)).view(np.int64), np.array(lens, dtype=np.int64)


def _counted(doc: np.ndarray, keys: np.ndarray, m: int) -> pa.Array:
    """For each of m documents its keys and how often each stands in it."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(first, len(doc)))
    begins = np.searchsorted(doc[first], np.arange(m + 1))
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.StructArray.from_arrays([pa.array(keys[first]), pa.array(tf.astype(np.int32))], names=["h", "tf"]))


def lm_score(docs: DataFrame, depth: int = DEPTH, frequent_grams: int = FREQUENT_GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    ``score`` is the model's log10 probability of the text, ``bits_per_byte`` its code length over its bytes and its end.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out(F.col("doc_id")))
    train = own.where(~F.col("held_out")).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        n = 0
        for block in blocks(batches):
            n += block.num_rows
            ids, hashes, _ = _block_words(raw(block.column(0)))
            have = _merge(have, hashes, np.bincount(ids, minlength=len(hashes)))
            if len(have[0]) > 2 * _FLUSH:
                yield record(_WORDS, *have)
                have = (have[0][:0], have[1][:0])
        yield record(_WORDS, *have)
        yield record(_WORDS, [None], [n])  # the end token

    counts = stash(train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0"), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.expr("case when h is null then c end")).alias("ends")).first()
    n_all, n_ends = total["n"] or 0, total["ends"] or 0
    unit = math.log10(n_all + ADD * (total["v"] + 1))
    top = counts.where("h is not null").orderBy(F.desc("c"), "h").limit(frequent).toArrow()
    top_h, top_c = np.asarray(top["h"]), np.asarray(top["c"])
    order = np.argsort(top_h)
    top_h, top_c = top_h[order], top_c[order].astype(float)
    grams_of = gram_table(own, depth)
    costs = gram_costs(grams_of, depth)
    drop_stash(grams_of)
    least, few = most_frequent(costs, frequent_grams)
    model = spark.sparkContext.broadcast((Lookup(np.asarray(few["gram"]), np.asarray(few["cost"])), top_h, top_c))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words_h, words_c = model.value
        row = TaskContext.get().partitionId() << 40
        log_c = np.log10(words_c + ADD) - unit
        for block in blocks(batches):
            texts = raw(block.column(1))
            m = len(texts)
            grams, n_bytes = text_grams(texts, depth)
            bits, hit = table.get(grams)
            tail = _counted(np.repeat(np.arange(m), n_bytes)[~hit], grams[~hit], m)
            bits = np.add.reduceat(bits, np.cumsum(n_bytes) - n_bytes)
            ids, hashes, lens = _block_words(texts)
            doc = np.repeat(np.arange(m), lens)
            at, known = _find(words_h, hashes)
            gain = np.where(known, log_c[at], 0.0) if len(words_h) else np.zeros(len(hashes))
            base = np.bincount(doc, weights=gain[ids], minlength=m) + math.log10(n_ends + ADD) - unit
            n_known = np.bincount(doc, weights=known[ids], minlength=m).astype(np.int64) + int(n_ends > 0)
            far = ~known[ids]
            rare = _counted(doc[far], hashes[ids[far]], m)
            yield pa.record_batch([pa.array(row + np.arange(m)), block.column(0), block.column(2), pa.array(lens + 1), pa.array(n_known), pa.array(base), pa.array(bits), pa.array(n_bytes), rare, tail], schema=_DOCS)
            row += m

    rows = stash(own.mapInArrow(score, _DOCS_DDL), "scored")
    rare = rows.select("k", F.explode("rare").alias("r")).select("k", "r.h", "r.tf")
    found = rare.join(counts.where("h is not null"), "h", "left")
    part = found.groupBy("k").agg(F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + ADD) - unit)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("also"))
    tail = rows.select("k", F.explode("grams").alias("r")).select("k", F.col("r.h").alias("gram"), "r.tf")
    tail = tail.join(costs.where(F.col("m") < least).select("gram", "cost"), "gram").groupBy("k").agg(F.sum(F.col("tf") * F.col("cost").cast("double")).alias("further"))
    out = rows.drop("rare", "grams").join(part, "k", "left").join(tail, "k", "left")
    bits = F.col("bits") + F.coalesce("further", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (bits * -math.log10(2)).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
