"""The training-data operators against brute force on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmatch.llm import _common, _tokens, decontaminate, license_scan, lm_score, near_dup, packing, quality, registry, simhash_dedup, suffix_dedup, token_counts, token_shards, url_filter
from quillmatch.llm._graph import components
from quillmatch.llm._tokens import TOKENIZER, Encoder, encoder, tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ñ", "ou"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and odd texts, ties, repeated rows, near copies, a long text."""
    rng = random.Random(3)
    own = [(i, prose(rng, rng.randint(1, 300))) for i in range(60)]
    own += [(60 + i, own[i][1]) for i in range(6)]  # copies
    own += [(70 + i, own[10 + i][1][:-30] + prose(rng, 3)) for i in range(6)]  # near copies
    own += [(80, None), (81, ""), (82, " \n\t "), (None, own[20][1]), (None, None), (83, "x" * 1500), (84, "ab" * 700), (85, prose(rng, 6000))]
    own += [own[5], own[5], (86, own[3][1] + " Licensed under the Apache License, all rigts reserved CC BY cc-by"), (87, "\x00\x1c é  <|endoftext|> a  b \n c")]
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those that operators make."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.select("*", F.lit(1).alias("n_words"), F.lit("z").alias("k1"), F.lit("q").alias("spans"), F.lit(0.5).alias("TEXT"), F.lit(9).alias("component_id"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def as_bytes(t):
    return (t or "").encode()


def test_license_scan(docs, rows, empty):
    got = bag(license_scan.license_scan(docs).drop("spans", "labels", "score"))
    want: Counter = Counter()
    for key, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", as_bytes(t).lower())
        starts, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.encode().split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        want[key, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    assert got == want
    assert license_scan.license_scan(empty).count() == 0


def test_license_fuzzy():
    n, _, first, last, base, labels, score, spans = license_scan.scan_text(b"x Redistribtion and use in sorce and binary forms! y")
    assert labels == "bsd" and base == "" and 0.8 < score < 1 and spans[0]["edits"] == 2 and (spans[0]["first_word"], spans[0]["last_word"]) == (1, 8)
    assert license_scan.scan_text(b"all rights removed")[5] == ""
    rng = random.Random(1)
    for _ in range(200):  # every notice with at most k edits is found
        notice, label = rng.choice(license_scan.NOTICES)
        k, s = max(1, len(notice) // license_scan.EDIT_EVERY), list(notice)
        for _ in range(k):
            i = rng.randrange(1, len(s) - 1)
            s[i : i + 1] = rng.choice([[], ["q"], [s[i], "q"]])
        assert any(license_scan.NOTICES[f[0]][0] == notice for f in license_scan.fuzzy_spans("aa bb " + "".join(s) + " cc"))


def test_license_words():
    for text in ("casino rights reserved", "volcano rights reserved", "no rights reservedly so", "overall rights reserved"):
        assert license_scan.scan_text(text.encode())[5] in ("", "reserved" * text.startswith("overall"))
    assert license_scan.scan_text(b"no rights reserved")[5] == "cc0"
    words = "alpha beta all right reserved no rights reserved gnu genral public license end".split()
    spans = license_scan.scan_text(" ".join(words).encode())[7]
    assert [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in spans] == [("reserved", 2, 4, 1), ("cc0", 5, 7, 0), ("gpl", 8, 11, 1)]


@given(st.lists(st.sampled_from("all rights reserved al right no reservd license x".split()), max_size=14))
@settings(max_examples=150, deadline=None)
def test_license_places(words):
    """Every place within the edits that stands alone is found, and nothing beyond them."""
    notices = (("all rights reserved", "r"),)

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    spans = license_scan.scan_text(" ".join(words).encode(), (), notices)[7]
    for s in spans:
        assert edits(s["found"], notices[0][0]) == s["edits"] <= 1
        assert s["found"].split() == words[s["first_word"] : s["last_word"] + 1]
    covered = {k for s in spans for k in range(s["first_word"], s["last_word"] + 1)}
    for i in range(len(words) - 2):
        if edits(" ".join(words[i : i + 3]), notices[0][0]) <= 1:
            assert covered & {i, i + 1, i + 2}


def test_license_before_a_better_match():
    joined = " all right reserved all rights reserved al rights reserved all rights reserved all rights reservd "
    own = [x for x in license_scan.fuzzy_spans(joined) if x[0] == 0]
    assert [x[3] for x in own] == [1, 0, 1, 0, 1]
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(own))


def test_url_filter(spark, sf, empty):
    urls = ["http://a.NET/x", "https://example.net/en/1?q#f", "http://x.example.net/en", "ftp://example.com/de/", "nourl", None, "http://", "http://fr.org/fr/2", "http://notexample.com/de/", "http://net/", "http://a.net", "http://EXAMPLE.com:80/de/", "a://b://c.net/", "http://u@m.example.com/de/x#/y", "http://.net/", "http://net./"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(list(url_filter.RULES), url_filter.RULES_DDL)
    got = bag(url_filter.url_filter(pages, rules))
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toArrow())
    assert got == Counter(tuple(r) for r in con.execute(url_filter.ORACLE).fetchall())
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert bag(url_filter.url_filter(pages, rules.limit(0)).select("verdict")) == {("allow",): len(urls) + 2}


def test_url_many_rules(spark):
    rng = random.Random(2)
    hosts = [".".join(rng.choices(["a", "b", "c", "com"], k=rng.randint(1, 4))) for _ in range(3000)]
    rules = {(rng.choice(hosts), rng.choice(["/", "/p", "/p/q"])): rng.choice(["allow", "block"]) for _ in range(300)}
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(['/', '/p', '/p/q/r', ''])}") for i in range(4000)]
    df = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(*k, v) for k, v in rules.items()], url_filter.RULES_DDL), "none")
    got = {r.page_id: (r.rule, r.verdict) for r in df.collect()}
    for i, u in pages:
        host, _, path = u[7:].partition("/")
        path = "/" + path if _ else ""
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for (h, p), v in rules.items() if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fit, default=None)
        assert got[i] == ((best[3], best[4]) if best else (None, "none"))


# --- tokens --------------------------------------------------------------------------


@given(st.lists(st.text(alphabet=st.sampled_from("ab '.,\n\t\r\x0b\x1c  　é9٣<|>s"), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    plain.encode_special_tokens = True
    ids, lens = encoder(TOKENIZER).block(pa.array([*texts, None], pa.string()))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert lens.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


@given(st.text(alphabet="ab '.,\n\té9", max_size=200))
@settings(max_examples=60, deadline=None)
def test_encoder_in_parts(text):
    code = encoder(TOKENIZER)
    _tokens.PART, whole = 10, _tokens.PART
    try:
        parts = code.ids(text).tolist()
    finally:
        _tokens.PART = whole
    assert parts == code.encode(text)


def test_encoder_on_documents(sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    texts = [r[0] for r in duckdb.execute(f"select text from '{sf}/documents.parquet'").fetchall()]
    ids, lens = Encoder(TOKENIZER).block(pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in plain.encode(t, add_special_tokens=False).ids]


def test_packing(docs, rows, empty):
    code = encoder(TOKENIZER)
    got = packing.pack(docs).collect()
    ids_of = Counter()
    by: dict = {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert len(ids) == r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    assert sum(r.length for r in got) == sum(len(code.block(pa.array([t or ""]))[0]) + 1 for _, t in rows)
    pieces = Counter()
    for key, t in rows:
        own = np.append(code.block(pa.array([t or ""]))[0], 1)
        assert any(s == 0 for s, _ in by[key, len(own)])
        for s, ids in by[key, len(own)]:
            pieces[key, len(own)] += 0
            ids_of[key, len(own)] += int(s == 0)
            if sum(k == key for k, _ in rows) == 1:
                assert (own[s : s + len(ids)] == ids).all()
    seq: dict = {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seq) == list(range(len(seq)))
    for own in seq.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        total = sum(n for _, n in own)
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(empty).count() == 0
    d = packing.digest(packing.pack(docs)).first()
    assert 0 <= d.ids_crc32 < 1 << 32


def test_packing_plan():
    combos = packing.combinations(60)
    assert {tuple(c) for c in combos} == {(a, b, 60 - a - b) for a in range(60) for b in range(max(a, 1), 60) if a <= b <= 60 - a - b}
    rng = np.random.default_rng(0)
    for scale in (0, 1, 40, 900):
        hist = np.zeros(257, dtype=np.int64)
        hist[1:] = rng.poisson(scale * np.exp(-np.arange(256) / 250))
        p = packing.Places(hist, 256)
        seq: dict = {}
        for length in range(1, 257):
            for rank in range(hist[length]):
                parts = p.place(length, rank)
                assert [x[0] for x in parts] == np.cumsum([0, *[x[1] for x in parts]])[:-1].tolist() and sum(x[1] for x in parts) == length
                for _, n, s, o in parts:
                    seq.setdefault(s, []).append((o, n))
        assert sorted(seq) == list(range(len(seq)))
        for own in seq.values():
            own.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
            total = sum(n for _, n in own)
            assert total <= 256 and (total == 256 or total & (total - 1) == 0)
        if scale == 900:
            assert p.used.sum() > 0.9 * hist[:256].sum()


@given(st.integers(1, 3000), st.integers(0, 1 << 70))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    slots = token_shards.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards.permute(slots, n, key, back=True) == np.arange(n)).all()


def test_shards(spark, docs, rows, tmp_path, empty):
    path, size = str(tmp_path / "s"), token_shards.stride(64)
    n = token_shards.write_shards(docs, path, length=64, per_shard=8)
    read = lambda at: sorted(token_shards.read_shards(spark, path, at, 64, 8).collect(), key=lambda r: r.slot)
    got = read(0)
    assert [r.slot for r in got] == list(range(n)) and sorted(r.sequence_id for r in got) == list(range(n))
    assert [token_shards.permute(np.array([r.sequence_id]), n)[0] for r in got] == list(range(n))
    assert all(len(r.payload) == 128 and r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * size for r in got)
    code = encoder(TOKENIZER)
    stream = Counter(x for r in got for x in np.frombuffer(bytes(r.payload), dtype="<u2")[: r.n_tokens].tolist())
    want = Counter(x for _, t in rows for x in [*code.block(pa.array([t or ""]))[0].tolist(), 1])
    assert stream == want
    assert [r.slot for r in read(n - 3)] == [n - 3, n - 2, n - 1]
    # a plain file each, read by seeking
    files = {int(f.parent.name[5:]) + int(f.name[5:10]): f for f in tmp_path.glob("s/from=*/part-*")}
    assert sorted(files) == list(range(-(-n // 8))) and sum(f.stat().st_size for f in files.values()) == n * size
    for r in got[:: max(1, n // 9)]:
        with files[r.shard].open("rb") as f:
            f.seek(r.byte_offset)
            raw = f.read(size)
        head = np.frombuffer(raw[:47], dtype=token_shards.HEADER)[0]
        assert (head["slot"], head["sequence"], raw[47:-1], raw[-1:]) == (r.slot, r.sequence_id, bytes(r.payload), b"\n")
    assert token_shards.write_shards(empty, str(tmp_path / "e")) == 0


def test_shards_keep_the_order(spark, rows, tmp_path):
    one = spark.createDataFrame([(2**61 + 1 if k == 7 else k, t) for k, t in rows], DOCS).coalesce(1)
    n = token_shards.write_shards(one, str(tmp_path / "o"), length=32, per_shard=16)
    got = sorted(token_shards.read_shards(spark, str(tmp_path / "o"), 0, 32, 16).collect(), key=lambda r: r.sequence_id)
    stream = [x for r in got for x in np.frombuffer(bytes(r.payload), dtype="<u2")[: r.n_tokens].tolist()]
    code, want, owner = encoder(TOKENIZER), [], []
    for k, (_, t) in enumerate(rows):
        ids = [*code.block(pa.array([t or ""]))[0].tolist(), 1]
        want += ids
        owner += [k] * len(ids)
    assert stream == want and len(got) == n
    key = [2**61 + 1 if k == 7 else k for k, _ in rows]
    for i, r in enumerate(got):
        a, b = owner[32 * i], owner[min(32 * i + 31, len(owner) - 1)]
        assert (r.first_doc, r.last_doc, r.n_docs) == (key[a], key[b], b - a + 1)


@given(st.text(alphabet="ab é\n.", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 12), st.text(alphabet="ab é\n.", max_size=9)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_edits(text, edits):
    code = encoder(TOKENIZER)
    parts = token_counts.leaves(text, 3)
    assert "".join(parts) == text
    tree = token_counts.DocumentTokens(parts, code.counts(parts), code.counts, 3)
    for at, n, new in edits:
        tree.edit(at, at + n, new)
        at = min(at, len(text))
        text = text[:at] + new + text[at + n :]
        assert tree.text() == text and tree.n_chars == len(text)
        assert tree.n_tokens == code.counts([text])[0]


def test_token_counts(docs, rows, empty):
    code = encoder(TOKENIZER)
    got = bag(token_counts.token_counts(docs).select("doc_id", "n_tokens", "n_tokens_edited"))
    patterns = [(re.compile(p, re.ASCII), new) for p, new in token_counts.REDACT]
    want: Counter = Counter()
    for key, t in rows:
        edited = t or ""
        for a, b, new in token_counts.find_edits(edited, patterns):
            edited = edited[:a] + new + edited[b:]
        want[key, code.counts([t or ""])[0], code.counts([edited])[0]] += 1
    assert got == want
    assert token_counts.find_edits("x a@b.co 1.2.3.4 y", patterns) == [(9, 16, "[address]"), (2, 8, "[email]")]
    assert token_counts.token_counts(empty).count() == 0


# --- suffix arrays ---------------------------------------------------------------------


@given(st.lists(st.binary(max_size=40) | st.text(alphabet="ab", max_size=40).map(str.encode), max_size=7), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_transform(slices, length):
    if not slices:
        return
    count = Counter(t[i : i + length] for t in slices for i in range(len(t) - length + 1))
    hit, at = suffix_dedup.repeated(slices, length), 0
    for t in slices:
        n = max(0, len(t) - length + 1)
        assert hit[at : at + n].tolist() == [count[t[i : i + length]] > 1 for i in range(n)]
        at += len(t) + 1


def removed(texts: list[bytes], length: int) -> list[tuple[int, int, int, bytes]]:
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(400, 64, 2048), (100, 16, 2048), (100, 16, 1), (100, 16, 2)])
def test_suffix_dedup(docs, rows, length, gram, crowd):
    got = bag(suffix_dedup.suffix_dedup(docs, length, gram, crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))
    want: Counter = Counter()
    for (key, _), (n, r, s, kept) in zip(rows, removed([as_bytes(t) for _, t in rows], length), strict=True):
        want[key, n, r, s, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_suffix_repeated_rows(spark):
    """Spans of a text stand once, however often its row is repeated."""
    rng = random.Random(8)
    shared = prose(rng, 90)
    texts = [(1, shared + prose(rng, 60))] * 200 + [(2, shared + prose(rng, 50)), (3, prose(rng, 40) + shared)]
    df = spark.createDataFrame(texts, DOCS).repartition(5)
    spans = suffix_dedup.repeated_spans(df.withColumns({"k1": F.col("doc_id"), "k2": F.col("doc_id")}), 100, 32).count()
    assert spans < 150
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, 100, 32).collect())
    plain = removed([as_bytes(t) for _, t in [texts[0], *texts[-3:]]], 100)  # two copies stand for all
    want: Counter = Counter()
    for (key, _), x, n in zip([texts[0], *texts[-2:]], [plain[0], *plain[-2:]], (200, 1, 1), strict=True):
        want[key, *x] += n
    assert got == want


def test_suffix_empty(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_runs_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    rng = random.Random(4)
    text = prose(rng, 900).encode()
    cover = np.zeros(len(text), dtype=int)
    for _, _, _, lo, n in suffix_dedup.runs([text, b"short"], 100, 16):
        for a, k in zip(lo.tolist(), n.tolist(), strict=True):
            cover[a : a + k] += 1
    assert (cover[: len(text) - 99] == 1).all() and not cover[len(text) - 99 :].any()


# --- near duplicates ---------------------------------------------------------------------


def plain_print(t: bytes) -> int:
    import xxhash

    w = WORD.findall(t.lower())
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: list[int], radius: int = 4) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, rows, empty):
    prints = [plain_print(as_bytes(t)) for _, t in rows]
    label = groups(prints)
    least: dict = {}
    for (key, _), g in zip(rows, label, strict=True):
        least[g] = min((k for k in (least.get(g), key) if k is not None), default=None)
    want = Counter((key, f"{p:016x}", least[g]) for (key, _), p, g in zip(rows, prints, label, strict=True))
    assert bag(simhash_dedup.simhash_groups(docs)) == want
    assert simhash_dedup.simhash_groups(empty).count() == 0
    kept = simhash_dedup.simhash_keep(docs, ("doc_id", "text")).collect()
    assert len(kept) == len(set(label))
    assert {r.doc_id for r in kept} == set(least.values())


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6])
def test_links_of_each_radius(spark, radius):
    rng = random.Random(radius)
    prints = {0, 1 | 1 << 32, 7, 7 << 32, 1, (1 << 64) - 1}
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(6):
            p = center
            for b in rng.sample(range(64), rng.randint(0, radius + 1)):
                p ^= 1 << b
            prints.add(p)
    own = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in own]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.label for r in components(simhash_dedup.links(df, radius)).collect()}
    by: dict = {}
    for p, g in zip(signed, groups(own, radius), strict=True):
        by.setdefault(g, []).append(p)
    for members in by.values():
        assert {got.get(p, p) for p in members} == {min(members)}


def test_links_in_crowds(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        for p in rng.sample(sorted(prints), 40):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 5), 2)}
    own = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in own]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.label for r in components(simhash_dedup.links(df)).collect()}
    label = groups(own)
    by: dict = {}
    for p, g in zip(signed, label, strict=True):
        by.setdefault(g, []).append(p)
    for members in by.values():
        assert {got.get(p, p) for p in members} == {min(members)}


def alike(texts: list[bytes]) -> list[int]:
    """Groups by links of equal sets of five-word windows, or of a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if up[a] != up[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            up = [up[a] if x == up[b] else x for x in up]
    return up


@pytest.mark.parametrize("limit", [300, 1 << 16])
def test_near_blocks(spark, limit):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(f"z{rng.randrange(10**6)}" if rng.random() < p else w for w in base) for p in (0.01, 0.02, 0.04, 0.3) for _ in range(12)]
    df = spark.createDataFrame([(i, 56, key, i, 0) for i in range(len(texts)) for key in (1, 2)], "s long, size long, key long, label long, own long")
    own = spark.createDataFrame(list(enumerate(texts)), "s long, text string")
    sets = [set(near_dup.shingles(t.encode()).tolist()) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(min(r), max(r)) for r in near_dup._apart(df, own, 5, 0.8, limit).collect()}
    assert want and got <= want and len(got) < len(want)

    def parts(links) -> set:
        up = list(range(len(texts)))
        for a, b in links:
            up = [up[a] if x == up[b] else x for x in up]
        return {frozenset(i for i, x in enumerate(up) if x == g) for g in set(up)}

    assert parts(got) == parts(want)


def test_near_overlaps(monkeypatch):
    monkeypatch.setattr(near_dup, "_COLUMNS", 7)
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40), (1, 30, 20, 9)))
    assert near_dup._overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_near_keep(spark, empty):
    rng = random.Random(11)
    own = []
    for i in range(0, 90, 3):  # a text, a copy with changed words, a text of its own
        t = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        u = list(t)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 8])):
            u[at] = f"v{rng.randrange(10**6)}"
        own += [(i, " ".join(t)), (i + 1, " ".join(u).upper().replace("V", "v")), (i + 2, prose(rng, 40))]
    base = [f"b{k}" for k in range(150)]
    for i in range(100, 160):  # a crowd in one bucket whose members are not all alike
        own.append((i, " ".join(f"z{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)))
    own += [(200, "a b"), (201, "A  b"), (202, "a c"), (203, None), (204, ""), (None, own[0][1]), own[5]]
    up = alike([as_bytes(t) for _, t in own])
    best: dict = {}
    for (key, t), g in zip(own, up, strict=True):
        best[g] = min(best.get(g, (True, 0, "")), (key is None, key or 0, t or ""))
    df = spark.createDataFrame(own, DOCS).repartition(3)
    got = near_dup.near_keep(df, ("doc_id", "text"))
    assert Counter(r.doc_id for r in got.collect()) == Counter(k for _, k, _ in best.values())
    assert near_dup.near_keep(empty, ("doc_id", "text")).count() == 0


def test_near_balls(spark, monkeypatch):
    """Texts whose fingerprints lie within 4 bits meet without a common band; their similarity decides."""
    import xxhash

    monkeypatch.setattr(near_dup, "band_hashes", lambda own: [int(own.view(np.int64).sum())])  # of each set alone
    rng = random.Random(17)

    def changed(n: int, k: int) -> tuple[str, str, int]:
        t = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        u = list(t)
        for at in range(6, 6 + 9 * k, 9):
            u[at] = f"v{rng.randrange(10**6)}"
        prints = []
        for x in (t, u):
            h = {xxhash.xxh64_intdigest(" ".join(x[i : i + 5]).encode(), 42) for i in range(n - 4)}
            prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        return " ".join(t), " ".join(u), (prints[0] ^ prints[1]).bit_count()

    own: list = []
    for n, k, count in ((300, 2, 6), (160, 4, 2)):  # of Jaccard similarity 0.93 and 0.77
        while count:
            t, u, bits = changed(n, k)
            if bits <= 4:
                own += [(len(own), t), (len(own) + 1, u)]
                count -= 1
    seen = [near_dup.band_hashes(near_dup.shingles(t.encode())) for _, t in own]
    up = alike([t.encode() for _, t in own])
    kept = {i for i, g in enumerate(up) if g == i}
    assert kept == {0, 2, 4, 6, 8, 10, 12, 13, 14, 15} and len({x for b in seen for x in b}) == len(own)
    got = near_dup.near_keep(spark.createDataFrame(own, DOCS), ("doc_id", "text"))
    assert {r.doc_id for r in got.collect()} == kept


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.label for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


# --- quality, language model, leaks ------------------------------------------------------


def plain_rules(t: bytes) -> tuple:
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen: set = set()
    dup = 0
    for line in t.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, len(re.findall(rb"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 3 > 0) for i in range(60)], "doc_id long, quality boolean").select("doc_id", F.col("quality").cast("int").alias("quality"), F.lit(1).alias("bucket"))
    got = quality.quality_rules(docs, labels)
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == Counter((key, *plain_rules(as_bytes(t))) for key, t in rows)
    assert got.where("base_failed and kept").count() == 0
    assert bag(got.where("kept").select("doc_id")) == bag(quality.quality_filter(docs, labels, ("doc_id", "text")).select("doc_id"))
    assert got.where("doc_id < 60 and doc_id % 3 > 0 and not base_failed and not kept").count() <= 1
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_quality_ratio(spark):
    """The score is the mean log ratio of hashed n-grams, and junk falls below the threshold."""
    rng = random.Random(8)
    good = [(i, prose(rng, 120)) for i in range(80)]
    bad = [(100 + i, " ".join(rng.choice(["zz###", "qq!!", "xx$$", "buy"]) + str(rng.randrange(40)) for _ in range(120))) for i in range(40)]
    docs = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[100 + i].kept for i in range(40))
    sums = np.ones((2, quality.BUCKETS))
    for key, t in good + bad:
        own = quality.buckets(*quality.word_ids(t.encode().split()))
        np.add.at(sums[1], own, 1)
        if key < 40:
            np.add.at(sums[0], own, 1)
    ratio = np.log((sums / sums.sum(axis=1, keepdims=True))[0] / (sums / sums.sum(axis=1, keepdims=True))[1])
    own = quality.buckets(*quality.word_ids(good[50][1].encode().split()))
    assert got[50].llr == pytest.approx(ratio[own].mean())


def test_repeat_words_of_many_kinds():
    ids = np.array([5, 6, 7, 1, 5, 6, 7], dtype=np.int64)
    assert quality.repeat_words(ids, 8) == 6
    assert quality.repeat_words(ids, (1 << 31) + 8) == 6


@pytest.mark.parametrize("frequent", [3, 1 << 18])
def test_lm_base(docs, rows, frequent):
    c: Counter = Counter()
    for key, t in rows:
        if zlib.crc32(str(key if key is not None else "").encode()) % 10:
            c.update([*WORD.findall(as_bytes(t).lower()), None])
    n, v = sum(c.values()), len(c)
    got = {}
    for r in lm_score.lm_score(docs, frequent=frequent).collect():
        got.setdefault((r.doc_id, r.n_tokens), r)
        assert r.score < 0 and math.isfinite(r.score)
    for key, t in rows:
        w = [*WORD.findall(as_bytes(t).lower()), None]
        r = got[key, len(w)]
        assert r.held_out == (zlib.crc32(str(key if key is not None else "").encode()) % 10 == 0)
        assert (r.n_known, r.train_tokens) == (sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


def test_lm_empty(empty, spark):
    assert lm_score.lm_score(empty).count() == 0
    r = lm_score.lm_score(spark.createDataFrame([(None, "a b")], DOCS)).first()  # no training text
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(-4 * 8 * math.log10(2))


def plain_tree(data: list[bytes], depth: int):
    """Sequential context-tree weighting for one bit position, by recursion."""
    grams = Counter()
    for t in data:
        padded = bytes(depth) + t + b"\0"
        for i in range(len(t) + 1):
            grams[padded[i : i + depth + 1]] += 1

    def counts(context: bytes, bits: str) -> tuple[int, int]:
        out = [0, 0]
        for g, n in grams.items():
            b = f"{g[-1]:08b}"
            if g[:-1].endswith(context) and b.startswith(bits):
                out[int(b[len(bits)])] += n
        return out[0], out[1]

    def log_kt(a: int, b: int) -> float:
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_pw(context: bytes, bits: str) -> float:
        a, b = counts(context, bits)
        if len(context) == depth:
            return log_kt(a, b)
        below = sum(log_pw(bytes([x]) + context, bits) for x in {g[depth - len(context) - 1] for g in grams if g[:-1].endswith(context) and f"{g[-1]:08b}".startswith(bits)})
        return math.log(0.5) + np.logaddexp(log_kt(a, b), below)

    def p_bit(context: bytes, bits: str, bit: int) -> float:
        def mix(d: int) -> float:
            own = context[len(context) - d :]
            a, b = counts(own, bits)
            kt = ((b, a)[1 - bit] + 0.5) / (a + b + 1)
            if d == depth:
                return kt
            below = log_pw(own, bits) - math.log(0.5)
            pe = log_kt(a, b)
            w = math.exp(pe - below)  # share of the node itself: pe / (pe + children)
            return w * kt + (1 - w) * mix(d + 1)

        return mix(0)

    return grams, lambda g: -sum(math.log2(p_bit(g[:-1], f"{g[-1]:08b}"[:j], int(f"{g[-1]:08b}"[j]))) for j in range(8))


@pytest.mark.parametrize("depth", [2, 3])
def test_context_tree(spark, depth):
    data = [b"abracadabra", b"abra cadabra abba", b""]
    grams, bits = plain_tree(data, depth)
    number = lambda g: int.from_bytes(g, "big")
    contexts = [bytes(depth - 2) + c for c in (b"ab", b"zz", b"xa", b"\0\0", b"\0a")] + [b"abra"[:depth]]
    every = [c + bytes([b]) for c in contexts for b in range(256)]
    seen = spark.createDataFrame([(number(g), n, n) for g, n in grams.items()] + [(number(g), 0, 1) for g in every if g not in grams], "gram long, n long, m long")
    got = {r.gram: r.cost for r in lm_score.gram_costs(seen.repartition(3), depth).collect()}
    for g in grams:
        assert got[number(g)] == pytest.approx(bits(g), rel=1e-5)
    for c in contexts:  # all bytes together have probability one
        assert sum(2 ** -got[number(c + bytes([b]))] for b in range(256)) == pytest.approx(1, abs=1e-4)


def test_subtrees_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    keys = sorted({rng.randrange(1 << 26) & 0x30303FF for _ in range(900)})
    df = spark.createDataFrame([(k, 1 + k % 5) for k in keys], "gram long, n long").repartition(2)
    monkeypatch.setattr(lm_score, "_SUBTREES", 50)
    one = lambda g, n: pa.record_batch([pa.array([len(g)]), pa.array([sum(set(((g >> 8) & 0xFFFF).tolist()))])], names=["n", "s"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = lm_score._subtrees(df, one, "n long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.n for r in got) == len(keys) and len(got) > 3
    assert sum(r.s for r in got) == sum({(k >> 8) & 0xFFFF for k in keys})  # no subtree is cut in two


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = lm_score.Lookup(keys[::2], (keys[::2] % 97).astype(np.float32))
    got, known = table.get(keys)
    assert known[::2].all() and not known[1::2].any() and (got[::2] == keys[::2] % 97).all()
    assert not lm_score.Lookup(keys[:0], np.zeros(0, np.float32)).get(keys)[1].any()


def test_lm_frequent_grams(docs):
    """What is looked up in the tasks changes no score."""
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score)
    every, few, none = (sorted(lm_score.lm_score(docs, frequent_grams=n).collect(), key=key) for n in (1 << 20, 40, 0))
    for a, b, c in zip(every, few, none, strict=True):
        assert a.score == pytest.approx(b.score, rel=1e-6) and a.score == pytest.approx(c.score, rel=1e-6)
        assert a.bits_per_byte > 0


def test_lm_learns(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, 200)) for i in range(120)] + [(500, "".join(chr(rng.randrange(33, 127)) for _ in range(1200)))], DOCS)
    rows = lm_score.lm_score(docs).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert held and sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held) * 1.0  # both are negative
    texts = {r.doc_id: r.text for r in docs.collect()}
    rate = {r.doc_id: -r.score / len(texts[r.doc_id].encode()) for r in rows}
    assert rate[500] > 1.5 * max(rate[r.doc_id] for r in held)


def test_lgamma():
    x = np.array([0.5, 1.0, 3.7, 20.5, 1e6])
    assert np.allclose(lm_score.lgamma(x), [math.lgamma(v) for v in x])


@pytest.mark.parametrize("max_broadcast", [0, 1_000_000])
def test_decontaminate(spark, rows, max_broadcast):
    item = "The train leaves Springfield at 7 and travels 120 km before Maria buys 3 apples for 15 dollars at the old market square"
    other = "A quick brown animal jumps over many lazy sleeping dogs while nobody watches the gate near the river bank"
    again = item.replace("7", "9").replace("120", "340").replace("Maria", "Olga").replace("15", "22").replace("Springfield", "Ridgeview")
    mixed = "The train leaves Springfield at 7 and travels 120 km before Maria buys 7 apples for 7 dollars at the old market square"
    extra = [(200, "Intro words here. " + item + " and more"), (201, again), (202, other), (203, "The train leaves on time"), (204, item[:60]), (None, other), (205, other), (205, other)]
    docs = spark.createDataFrame(rows + extra, DOCS).withColumn("w", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (4, ""), (5, "too short"), (None, mixed.replace("train", "coach"))], "item_id long, text string").withColumn("h", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.decontaminate(docs, bench, max_broadcast=max_broadcast).collect()}
    assert set(got) == {(200, 1), (201, 1), (202, 2), (None, 2), (205, 2)}
    assert got[200, 1].exact and not got[201, 1].exact and got[201, 1].slots > 3 and got[201, 1].conflicts == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_slot_conflicts(spark):
    """One value of the item that stands for several values of the text is another question."""
    item = "first add 5 apples to the big basket then take 5 pears from the small box and put 5 plums on the long table"
    same, mixed = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    docs = spark.createDataFrame([(1, same), (2, mixed)], DOCS)
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_runs_and_short_items(spark):
    item = "The courier rode to New York with twenty one letters before Anna Lena paid 30 euros for the long way back to town"
    again = item.replace("New York", "Paris").replace("twenty one", "7").replace("Anna Lena", "Tom").replace("30", "one hundred and five".replace(" and", ""))
    docs = [(1, again), (2, "He asked: what is 12 times 7? Nobody knew."), (3, "He asked: what is 13 times 7? Nobody knew."), (4, "we saw Rome and Paris"), (5, None), (6, "we saw")]
    bench = [(1, item), (2, "what is 12 times 7?"), (3, "we saw Paris and Rome"), (4, "we saw")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2)}


def test_reparameterised_items(spark, sf):
    """Other figures, names and units in every item: all are found, and no text without an item."""
    rng = random.Random(12)
    nouns = "driver farmer baker train garden river market teacher window letter engine bottle basket bridge ladder".split()
    verbs = "carries sells finds moves paints counts repairs collects divides measures".split()
    names = "Anna Boris Clara David Emma Frank Greta Hugo".split() + ["New York", "San Marino", "Paris", "Oslo"]

    def item(words: list[str], slots: list[str]) -> str:
        return " ".join(w if w != "#" else slots.pop(0) for w in words)

    bench, docs = [], []
    for k in range(60):
        words = ["the", rng.choice(nouns)]
        while len(words) < 30:
            words += [rng.choice(verbs), "the", rng.choice(nouns), rng.choice(["near", "behind", "after", "without"]), "#", "and"]
        n = words.count("#")
        one = [rng.choice([str(rng.randrange(2, 900)), rng.choice(names)]) for _ in range(n)]
        other = {x: rng.choice(names) if x[0].isalpha() else rng.choice([str(rng.randrange(2, 900)), "forty two"]) for x in one}
        two = [other[x] for x in one]  # a value of the item stands for one value of the text
        bench.append((k, item(words, one)))
        docs.append((k, prose(rng, 30) + " " + item(words, two) + " " + prose(rng, 20)))
    docs += [(1000 + k, prose(rng, 120)) for k in range(100)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    found = {d for d, i in got if d == i}
    assert len(found) >= 0.9 * 60, len(found)
    assert not [d for d, _ in got if d >= 1000]


def test_planted_items(spark, sf):
    got = bag(registry.QUERIES["op6_decontaminate"](spark, sf).select("doc_id", "item_id"))
    want = duckdb.execute(f"select doc_id, item_id from '{sf}/documents.parquet' d join '{sf}/benchmark.parquet' b on contains(d.text, b.text)").fetchall()
    assert set(got) == set(want)


# --- queries and the pipeline ---------------------------------------------------------------


def test_registry(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert bag(registry.QUERIES["op2_url_filter"](spark, sf)) == Counter(tuple(r) for r in con.execute(registry.ORACLES["op2_url_filter"]).fetchall())


def test_pick(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
    assert _common.pick(df, "text").first()[0] == "a" and _common.pick(df, "TEXT").first()[0] == "b"
    with pytest.raises(ValueError):
        _common.pick(df, "nothing")


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert len(names) == 5 and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = [tuple(r) for r in docs.select(*p.COLUMNS).collect()]
    # the same by brute force
    step = _common.stash(p.quality(spark, docs, sf), "t")
    verdict = {r.doc_id: r.kept for r in registry.QUERIES["op10_quality_rules"](spark, sf).collect()}
    own = [r for r in own if verdict[r[0]]]
    assert bag(step) == Counter(own)
    step = _common.stash(p.near_duplicates(spark, step, sf), "t")
    label = alike([r[1].encode() for r in own])
    own = [own[i] for i in sorted({g: min((own[k][0], k) for k in range(len(own)) if label[k] == g)[1] for g in set(label)}.values())]
    assert bag(step) == Counter(own)
    step = _common.stash(p.repeated_strings(spark, step, sf), "t")
    cut = removed([r[1].encode() for r in own], p.REPEATED_BYTES)
    own = [(r[0], x[3].decode(errors="ignore") if x[1] else r[1], r[2], r[3]) for r, x in zip(own, cut, strict=True)]
    got = step.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    clean = lambda t: t.replace("�", "")
    assert Counter((r.doc_id, clean(r.text), r.lang, r.source) for r in got) == Counter((a, clean(t), b, c) for a, t, b, c in own)
    items = [r[0] for r in duckdb.execute(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    last = _common.stash(p.decontamination(spark, step, sf), "t")
    assert {r.doc_id for r in last.collect()} == {r[0] for r in own if not any(i in r[1] for i in items)}
    packed = p.packing(spark, last, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(encoder(TOKENIZER).counts([r.text for r in last.collect()])) + last.count()
    assert p.run(spark, sf).count() == packed.count()


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table, by the definitions of corpus_pipeline."""
    import corpus_pipeline as p

    rng = random.Random(21)
    one, two = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(90)) for _ in range(2))
    item = " ".join(f"item{rng.randrange(10**5)}" for _ in range(30))
    own = [(1, one), (1, one), (2, one + " end"), (None, two), (3, None), (4, ""), (5, "too short"), (6, two + " " + item)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, k1 string, s string, row long"
    df = spark.createDataFrame([(k, t, None, "s", None, "x", "y", 7) for k, t in own], columns)
    df.repartition(2).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for at in "ab":
        spark.createDataFrame([(99, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / at / "labels.parquet"))
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / at / "benchmark.parquet"))
    code = encoder(TOKENIZER)
    got = {(r.doc_id, r.doc_tokens) for r in p.run(spark, str(tmp_path / "a")).collect()}
    # 1 and 2 are near copies; the null id and 6 share a long string, which goes from both, and 6 holds the item
    assert got == {(1, code.counts([one])[0] + 1), (None, 1)}
    assert p.run(spark, str(tmp_path / "b")).count() == 0
