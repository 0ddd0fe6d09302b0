"""Hand-made cases: normalising, caps, segments, JSON, sources, streaming."""

from __future__ import annotations

import hashlib
import io
import json
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmatch.functions import hashing as H
from quillmatch.functions import jsonops as J
from quillmatch.functions import text as T
from quillmatch.functions._udf import arrow
from quillmatch.operators import catalog, index, search, segments
from quillmatch.plans.config import SearchConfig
from quillmatch.plans.shared import spread
from quillmatch.queries import QUERIES
from quillmatch.sources import corpus
from quillmatch.streaming import ingest


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), (None, ""), ("  A  B ", "a b"), ("café", "caf"), ("café", "cafe"), ("Ёжик ёлка", "ежик елка"),
        ("İstanbul ı", "istanbul i"), ("_x_ 1,2", "_x_ 1 2"), ("a b c", "a b c"), ("so­ft", "so ft"), ("\U0001f600x", "x"), ("schön", "sch n"), ("Ў", "Ў"),
    ],
)
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("text")), text=text) == want


def test_shingles(spark):
    df = T.with_tokens(spark.createDataFrame([(1, " ".join("abcdefghij")), (2, "a b"), (3, "")], "id long, text string"))
    rows = {r.id: r for r in df.select("id", T.shingle_list("words").alias("s"), F.size("words").alias("n")).collect()}
    assert rows[1].s == ["a b c d e f g h i", "b c d e f g h i j"]
    assert rows[2].s == [] and rows[3].s == [] and rows[3].n == 0


def test_long_text(spark, tmp_path):
    """Every word and window of a text counts, also beyond 100,000 words."""
    text = " ".join(f"w{i}" for i in range(100_500))
    spark.createDataFrame([(1, text), (2, " ".join(text.split()[:50_020]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.tok_len for r in QUERIES["token_counts"](spark, str(tmp_path)).collect()} == {1: 100_500, 2: 50_020}
    assert len({r.signature_sha1 for r in QUERIES["minhash_signatures"](spark, str(tmp_path)).collect()}) == 2
    s = index.stats(spark.read.parquet(f"{tmp_path}/documents.parquet")).first()
    assert s.pairs_before_dedup == 100_492 + 50_012 and s.shingles == 100_492


def test_hashes_of_all_windows(spark, tmp_path):
    texts = {1: "A b c d e f g h i J k", 2: "a b c d e f g h i x y z", 3: "a b c d e", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda k: {(i, p): " ".join(w[p : p + k]) for i, t in texts.items() for w in [(t or "").lower().split()] for p in range(len(w) - k + 1)}
    got = {(r.doc_id, r.position): r.h & (1 << 64) - 1 for r in QUERIES["fnv_windows"](spark, str(tmp_path)).collect()}
    assert got == {at: H.fnv1a64_py(g.encode()) for at, g in cut(9).items()}
    got = {(r.doc_id, r.position): int(r.k) for r in QUERIES["sha1_windows"](spark, str(tmp_path)).collect()}
    assert got == {at: int.from_bytes(hashlib.sha1(g.encode()).digest()[:8], "big") for at, g in cut(5).items()}


def test_cleaners(spark):
    assert one(spark, T.merge_hyphen_breaks(F.col("t")), t="exam-\n ple") == "example"
    assert one(spark, T.collapse_line_breaks(F.col("t")), t="a\nb\n\nc") == "a b\n\nc"
    assert one(spark, T.norm_spaces(F.col("t")), t=" a \t b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, T.norm_spaces(F.col("t")), t="a\tb \n\n c\n") == "a\tb\n\nc"
    assert one(spark, T.merge_hyphen_breaks(F.col("t")), t="ab-\ncd-\nef 1-\n2") == "abcd-\nef 1-\n2"
    assert one(spark, T.collapse_line_breaks(F.col("t")), t="\na\nb") == "\na b"
    assert one(spark, T.fix_small_splits(F.col("t")), t="th e en\td of ally") == "theend of ally"
    assert one(spark, T.pdf_cleanup(F.col("t")), t="\ufeffWord\u00ady exam-\r\nple in\u00a0it \n\n\n x") == "Wordy example init\n\nx"
    wide = {"йод её café Їжак": "йод ее café їжак", "Straße-\n Ende": "strasseende", "co-\n operate x\u0301y": "cooperate xy", "ﬁne\u00a0İ": "fine i", "e\u0301a": "éa"}
    for t, want in wide.items():
        assert one(spark, T.normalize_wide("t"), t=t) == want
    assert one(spark, T.alpha_density(F.col("t")), t="") == 0.0
    assert one(spark, T.nfkc_lower("t"), t="ﬁ​ Å") == "fi å"
    assert one(spark, T.html_text("t"), t="<p>a<b>b</b><script>x</script><!-- c --></p>&amp;") == "a b &"


def test_pieces(spark):
    """A Python function sees about 1 MB at once, however long the texts of an Arrow batch are; all rows come back in order."""
    import pandas as pd

    @arrow("struct<seen: long, own: long>")
    def sizes(batches):
        for s in batches:
            own = s.map(lambda t: 0 if t is None else len(t))
            yield pd.DataFrame({"seen": [int(own.sum())] * len(s), "own": own})

    df = spark.range(0, 2000, 1, 1).select("id", F.expr("case when id % 7 = 0 then null else repeat('x', cast(id * 5 as int)) end").alias("t"))
    rows = df.union(spark.range(1).select("id", F.expr("repeat('y', 3000000)"))).select("id", "t", sizes("t").alias("s")).collect()
    assert all(r.s.own == len(r.t or "") for r in rows) and len(rows) == 2001
    assert max(r.s.seen for r in rows[:-1]) <= 1 << 20 and rows[-1].s.seen == 3_000_000


@given(st.binary(max_size=40))
def test_fnv_batch(data):
    assert int(H.fnv1a64_batch([data, b"", data + b"x"])[0]) == H.fnv1a64_py(data)


def test_fnv_sql(spark):
    for t in ("", "a", "été 9"):
        want = H.fnv1a64_py(t.encode())
        want = want - (1 << 64) if want >> 63 else want
        assert one(spark, H.fnv1a64_sql(F.col("t")), t=t) == want
        assert one(spark, H.fnv1a64("t"), t=t) == want


def test_shards_and_sketches(spark):
    assert one(spark, H.shard_md5(F.col("t"), 8), t="u|f|g") == int(hashlib.md5(b"u|f|g").hexdigest()[:16], 16) % 8
    import zlib

    assert one(spark, H.shard_crc32(F.col("t"), 8), t="||") == zlib.crc32(b"||") % 8
    assert (H.minhash_py(np.zeros(0, dtype=np.uint64)) == 0xFFFFFFFF).all()
    rng = random.Random(1337)  # multipliers first, then addends, each from 64 drawn bits
    drawn = [rng.getrandbits(64) for _ in range(6)]
    a, b = H.minhash_constants(3)
    assert a.tolist() == [(x | 1) & 0xFFFFFFFF for x in drawn[:3]] and b.tolist() == [x & 0xFFFFFFFF for x in drawn[3:]]
    a, b = np.arange(100, dtype=np.uint64) * 977, np.arange(20, 120, dtype=np.uint64) * 977
    near = (H.minhash_py(a) == H.minhash_py(b)).mean()
    assert abs(near - 80 / 120) < 0.15
    sig = H.minhash_py(a).astype(np.int64).tolist()
    df = spark.createDataFrame([(1, sig), (2, sig), (3, H.minhash_py(b).astype(np.int64).tolist())], "doc_id long, signature array<long>")
    assert (2, 1) in {tuple(r) for r in H.lsh_candidates(df).collect()}
    band = df.select(H.band_keys(F.col("signature"))[0]["bucket"]).first()[0]
    assert band == hashlib.sha1(b"".join(x.to_bytes(4, "big") for x in sig[:4])).digest()[:8].hex()
    words = ["a", "b", "b"]
    hi, lo = spark.createDataFrame([(words,)], "w array<string>").select(H.simhash128("w").alias("h")).select("h.hi", "h.lo").first()
    for got, seed in ((hi, H.FNV_PRIME), (lo, H.FNV_BASIS)):
        hs = [H.fnv1a64_py(w.encode(), seed) for w in words]
        assert got % (1 << 64) == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) >= len(hs))


def test_tokens_are_what_stands_between(spark):
    """Words are matched; splitting at all other characters gives the same ones."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("aZ_09 .,-\u0301\u0451\u0401\u0130\u00e9\u0400\u04ff\u0500\u00ad\u200b\U0001f600\n\t\u00a0\u212a", k=rng.randrange(40))) for _ in range(500)]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.tokens(F.col("text")).alias("w"), T.normalize(F.col("text")).alias("n")).collect():
        low = "".join(c for c in r.text if not "\u0300" <= c <= "\u036f").translate(str.maketrans(T._UP, T._LOW))
        assert r.w == [w for w in re.split("[^_0-9a-z\u0400-\u04ff]+", low) if w] and r.n == " ".join(r.w)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_negated_class_for_words(spark):
    """A negated class costs Java a microsecond a character."""
    assert "[^" not in plan_of(T.with_tokens(spark.range(1).selectExpr("string(id) as text")))


def test_windows_without_lambdas(spark, tmp_path):
    """Positions are exploded; windows and keys are those of the arrays."""
    text = " ".join(f"w{i % 7}" for i in range(40))
    spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("sha1_windows", "fnv_windows"):
        assert "lambdafunction" not in plan_of(QUERIES[name](spark, str(tmp_path)))
    words = T.with_tokens(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    own = T.each_window(words).select("position", F.xxhash64(T.window_words()).alias("key")).orderBy("position").collect()
    assert [r.key for r in own] == words.where("doc_id = 1").select(T.shingle_keys("words")).first()[0]


def test_frequencies_without_partial_tables(spark, tmp_path):
    """Keys are shuffled as they are, to as many tasks as the input's size asks for."""
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = plan_of(QUERIES["index_stats"](spark, str(tmp_path)))
    assert "hashpartitioning(key" in plan and "REPARTITION_BY_NUM" in plan
    assert tuple(QUERIES["index_stats"](spark, str(tmp_path)).first()) == (1, 1, 0, 4, 4, 4, 1)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert spread(docs) == 4
    assert spread(spark.createDataFrame([(i, "x" * 1_000_000) for i in range(50)], "id long, text string")) >= 4


def test_index_is_shuffled_once(spark):
    """Postings go through one shuffle each; a document in several rows counts once, also one without an id; validation sees every fault."""
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text), (1, text + " x"), (2, text), (None, text), (None, text), (3, "short"), (4, text), (4, text)], "doc_id long, text string")
    for own in (docs, docs.where("doc_id = 2"), docs.where("doc_id = 3"), docs.withColumn("segment_id", F.expr("coalesce(doc_id, 0) % 2"))):
        made = index.build(own)
        got = Counter(tuple(r) for r in made.postings.collect())
        seg = F.col("segment_id") if "segment_id" in own.columns else F.lit(0)
        words = T.with_tokens(own.select(seg.alias("segment_id"), "doc_id", "text")).collect()
        want = {(r.segment_id, r.doc_id, tuple(r.words[i : i + 9])) for r in words for i in range(len(r.words) - 8)}
        assert set(got.values()) <= {1} and len(got) == len(want)
        nulls = sum(d is None for _, d, _ in want)
        assert tuple(index.validate(made).first()) == (0, nulls, 0, nulls > 0)
        n = Counter(g for s, _, g in want) if seg is not None and "segment_id" not in own.columns else None
        if n is not None:
            hist = {r.df: r.n for r in index.frequencies(made.postings, own, "segment_id", "key").groupBy("df").agg(F.count("*").alias("n")).collect()}
            assert hist == Counter(n.values())
    posts = spark.createDataFrame([(0, 7, 1), (0, 7, 1), (0, 7, 1), (0, 8, 1), (0, 8, 1), (1, 7, 1), (0, 7, 5), (0, 9, None)], "segment_id int, key long, doc_id long")
    meta = spark.createDataFrame([(0, 1, 9), (0, 1, 8), (1, 1, 9), (0, 6, 3), (0, None, 9)], "segment_id int, doc_id long, tok_len int")
    assert tuple(index.validate(index.Index(posts, meta)).first()) == (2, 2, 2, 2)
    empty = index.Index(posts.limit(0), meta.limit(0))
    assert tuple(index.validate(empty).first()) == (0, 0, 0, 0)
    spark.range(200).selectExpr("id as doc_id", "repeat(concat(id, ' '), 20) as text").createOrReplaceTempView("lots")
    deals = lambda df: [x.split("hashpartitioning(")[1].split(")")[0] for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in x and re.search("key#|h#", x.split("hashpartitioning(")[1].split(")")[0])]
    made = index.build(spark.table("lots"))
    assert len(deals(index.frequencies(made.postings, spark.table("lots"), "segment_id", "key").groupBy("df").count())) == 1
    assert not deals(index.validate(made))


# --- search against plain Python ---------------------------------------------------


def plain(queries, docs, c, profile):
    def grams(t):
        w = t.split()
        return [" ".join(w[i : i + 9]) for i in range(len(w) - 8)]

    post = defaultdict(set)
    length = {d: len(t.split()) for d, t in docs}
    for d, t in docs:
        for g in grams(t):
            post[g].add(d)
    out = {}
    for q, t in queries:
        every = set(grams(t))
        if profile == "M":  # the smallest keys, before the lookup
            every = set(sorted(every, key=KEYS.get)[: c.max_terms])
        terms = sorted({g for g in every if g in post and len(post[g]) <= c.max_df}, key=lambda g: (len(post[g]), KEYS[g]))
        if profile == "G":
            terms = terms[: c.max_terms]
        seeds, total = [], 0
        for g in terms[: c.fetch]:
            if seeds and c.max_df_sum and total + len(post[g]) > c.max_df_sum:
                break
            total += len(post[g])
            seeds.append(g)
        hits = Counter(d for g in seeds for d in post[g])
        cand = dict(sorted(hits.items(), key=lambda x: (-x[1], x[0]))[: c.max_candidates])
        own = terms[: c.rare_terms] if profile == "M" else terms
        rows = []
        for d, n in cand.items():
            i = sum(d in post[g] for g in own)
            if i and length[d] > 8:
                j, k = i / (len(own) + length[d] - 8 - i), i / len(own)
                rows.append((c.weight * (c.alpha * j + (1 - c.alpha) * k), d, n))
        for r, (s, d, n) in enumerate(sorted(rows, key=lambda x: (-round(x[0], 12), x[1]))[: c.top_k], 1):
            out[q, d] = (round(s, 9), n, r)
    return out


KEYS: dict[str, int] = {}


@pytest.mark.parametrize("profile", ["G", "M"])
@pytest.mark.parametrize("tight", [False, True])
def test_search_caps(spark, profile, tight):
    rng = random.Random(5)
    base = [rng.choice("abcdefg") + str(rng.randrange(30)) for _ in range(400)]
    docs = [(d, " ".join(base[(s := rng.randrange(300)) : s + rng.randrange(5, 200)])) for d in range(60)]
    queries = [(q, " ".join(base[(s := rng.randrange(200)) : s + 150])) for q in range(6)]
    df = T.with_tokens(spark.createDataFrame(docs + queries, "id long, text string"))
    for r in df.select(F.explode(F.arrays_zip(T.shingle_list("words").alias("s"), T.shingle_keys("words").alias("k"))).alias("x")).select("x.*").collect():
        KEYS[r[0]] = r[1]
    c = SearchConfig(fetch=16, max_df=25, max_df_sum=60, max_candidates=5, max_terms=128, rare_terms=32) if tight else SearchConfig()
    hits = search.search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), c, profile)
    got = {(r.query_id, r.doc_id): (round(r.score, 9), r.cand_hits, r["rank"]) for r in hits.collect()}
    want = plain(queries, docs, c.clamped(profile), profile)
    assert got == want


def test_merge_and_local_k(spark):
    rows = [(1, 7, 0, 0.5, 0.1, 0.2, 3, 1), (1, 7, 1, 0.5, 0.1, 0.2, 9, 1), (1, 8, 1, 0.6, 0.1, 0.2, 2, 1), (1, 7, 2, 0.4, 0.3, 0.3, 4, 1)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, segment_id int, score double, j9 double, c9 double, cand_hits long, rank int")
    got = [tuple(r) for r in search.merge_segments(df, 5).orderBy("rank").collect()]
    assert got == [(1, 8, 1, 0.6, 0.1, 0.2, 2, 1, 1), (1, 7, 0, 0.5, 0.1, 0.2, 9, 3, 2)]
    assert [search.local_k(n, 10) for n in (1, 9, 65, 513)] == [40, 30, 20, 10]
    assert search.local_k(1, 5000) == 8000


def test_index_round_trip(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("a", text), ("b", text + " more"), ("c", "too short")], "doc_id string, text string")
    made = index.build(docs)
    index.write(made, str(tmp_path / "i"), 2)
    back = index.load(spark, str(tmp_path / "i"))
    assert sum(index.validate(back).first()) == 0
    hit = search.search_text(text, back).orderBy("rank").first()
    assert (hit.doc_id, hit.decision, hit.c9) == ("a", "plagiarism", 1.0)
    assert search.search_text("  ", back).count() == 0
    with pytest.raises(ValueError):
        index.require_documents(index.build(docs.where("doc_id = 'c'")))


def test_config():
    c = SearchConfig.from_dict({"w_min_doc": 5, "weights": {"alpha": 7}, "thresholds": {"plag_thr": 0.9}, "other": 1})
    assert (c.min_doc_tokens, c.alpha, c.plagiarism, c.extra) == (5, 1.0, 0.9, {"other": 1})
    assert SearchConfig(max_terms=5).clamped("G").max_terms == 128
    assert SearchConfig(top_k=9999).clamped("M").top_k == 2000
    with pytest.raises(ValueError):
        c.clamped("X")


def test_segments(spark):
    docs = spark.createDataFrame([(i, i % 2, None, "uploaded") for i in range(45)], "doc_id long, shard_id int, segment_id long, status string")
    segs = spark.createDataFrame([], "segment_id long, shard_id int, level int, status string, doc_count long")
    docs, segs = segments.tick(docs, segs, 2, per_segment=5, fan_in=2)
    by = Counter((r.level, r.status) for r in segs.collect())
    assert by == {(1, "merged"): 8, (1, "ready"): 2, (2, "ready"): 4}
    assert docs.where("status <> 'indexed' or segment_id is null").count() == 0
    s = catalog.status(docs, segs).first()
    assert (s.level0_docs, s.ready_l1, s.ready_l2) == (0, 2, 4)
    assert segments.first_levels(segs, 1).count() == 2 and segments.searchable(segs, 0).count() == 3
    base = segments.rebuild_base(docs.withColumn("status", F.lit("l5_uploaded")).where("doc_id < 3"))
    more = segments.extend_base(docs.withColumn("status", F.lit("l5_uploaded")), base)
    assert more.where("base_id = 2").count() == 42
    with pytest.raises(ValueError):
        segments.extend_base(docs.withColumn("status", F.lit("l5_uploaded")), more)


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    t = c.enqueue("build", {"a": 1})
    assert c.next_task()["task_id"] == t and c.next_task() is None
    other = c.enqueue("build", {"a": 2})
    claim, fs = c._fs(f"{c.root}/_claims/{other}-0")
    assert fs.createNewFile(claim) and c.next_task() is None  # another worker was first
    c.finish_task(t, "x" * 3000)
    row = c.table("index_tasks").where(F.col("task_id") == t).first()
    assert (row.status, row.attempts, len(row.last_error)) == ("failed", 1, 2000)
    c.log_error("etl", "E1", "bad", doc_id=3)
    c.append("documents", spark.createDataFrame([(1, 0, "uploaded"), (2, 1, "uploaded")], "doc_id long, shard_id int, status string"))
    with pytest.raises(ValueError):
        c.reset()
    assert c.reset(shard_id=1, confirm=True)["documents"] == 1
    assert c.table("documents").count() == 1 and c.table("index_errors").count() == 1
    # what a crash leaves aside changes nothing, and old versions are gone
    spark.range(3).write.parquet(f"{c.root}/_documents-left")
    assert c.table("documents").count() == 1 and len(list((tmp_path / "cat" / "documents").glob("v*"))) == 1
    c.append("segments", spark.createDataFrame([(1, 0, 1, "ready"), (2, 0, 1, "ready")], "segment_id long, shard_id int, level int, status string"))
    c.touch_segments([2])
    c.retire_segments([1])
    assert {r.segment_id: (r.status, r.last_access_at is not None) for r in c.table("segments").collect()} == {1: ("retired", False), 2: ("ready", True)}


# --- JSON --------------------------------------------------------------------------


def test_json(spark):
    assert J.pointer_path("/a/0/b~1c~0d") == "$['a'][0]['b/c~d']"
    for bad in ("a", "/~2", "/~"):
        with pytest.raises(ValueError):
            J.pointer_path(bad)
    t = '{"a": {"b/c": [1, 2.50, "x"]}, "a~": null, "Key": "v"}'
    assert one(spark, J.at_pointer(F.col("t"), "/a/b~1c/2"), t=t) == "x"
    assert one(spark, J.at_pointer(F.col("t"), "/a/b~1c/9"), t=t) is None
    assert one(spark, J.at_pointer(F.col("t"), "/a/b~1c/0", "long"), t=t) == 1
    assert one(spark, J.field_any_case(F.col("t"), "kEY"), t=t) == "v"
    assert one(spark, J.first_field(F.col("t"), "k"), t='{"k": 1, "k": 2}') == "1"
    assert one(spark, J.minify("t"), t='{ "a b" : [ 1 , 2.50 ] }') == '{"a b":[1,2.50]}'
    assert json.loads(one(spark, J.prettify("t"), t=t)) == json.loads(t)
    for text, ok in (("1", True), ("NaN", False), ('{"a":1} x', False), ("", False), ("[" * 5 + "]" * 5, True), ('"\x01"', False), ("01", False)):
        assert one(spark, J.is_valid("t"), t=text) is ok, text
    for text, kind in (("[]", "array"), ("{}", "object"), ("1", "int64"), ('"s"', "string"), ("true", "bool"), ("null", "null"), ("1.5", "double"), ("x", None)):
        assert one(spark, J.type_tag(F.col("t")), t=text) == kind
    assert J.stats_py('{"a": [1, 2.0, "xy", null, {}], "a": true}')["repeated_keys"] == 1
    assert J.stats_py('{"a": [1, 2.0, "xy", null, {}]}')["depth"] == 3
    assert J.msgpack_py({"a": [1, -1, "x", None, True, 1.5]}).hex() == "81a16196" + "01ff" + "a178" + "c0c3" + "cb3ff8000000000000"
    got = J.split_stream_py('1, 2, "a", {"hello":"world"}, [1,2,3], x')
    assert [g[1] for g in got] == ["1", "2", '"a"', '{"hello":"world"}', "[1,2,3]", None]


# --- sources and streams --------------------------------------------------------------


def test_sources(spark, tmp_path):
    lines = ['{"doc_id": "a", "text": "x"}', "", '{"doc_id": 3, "text": "x"}', '{"doc_id": "b", "text": ""}', "{", '{"doc_id": "c", "text": "y", "title": 1}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert sorted(r.doc_id for r in corpus.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect()) == ["a", "c"]
    assert tuple(corpus.count_lines(spark, str(tmp_path / "c.jsonl")).first()) == (5, 2, 3)
    files = tmp_path / "f"
    files.mkdir()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(files / "z.zip", "w") as z:
        z.writestr("in.html", "<b>hi</b>")
        z.writestr("__MACOSX/x", "no")
        z.writestr("d/", "")
        z.writestr("empty.txt", "")
        z.writestr("w.docx", buf.getvalue())
    (files / "a.txt").write_bytes(b"ok\xff!")
    (files / "p.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1].rsplit("!", 1)[-1]: r.text for r in corpus.read_files(spark, str(files)).collect()}
    assert got == {"in.html": "hi", "w.docx": "one\ntwo", "a.txt": "ok!"}
    assert corpus.new_documents(corpus.read_files(spark, str(files))).where("status = 'l5_uploaded'").count() == 3
    (tmp_path / "s.json").write_text('{"a":1}{"b":2} 3')
    assert corpus.read_json_stream(spark, str(tmp_path / "s.json")).count() == 3
    out = str(tmp_path / "out")
    corpus.write_jsonl(corpus.read_jsonl(spark, str(tmp_path / "c.jsonl")), out)
    assert corpus.read_jsonl(spark, out).count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    text = " ".join(f"w{i}" for i in range(15))
    for name in ("a", "b"):
        (src / f"{name}.jsonl").write_text(json.dumps({"doc_id": name, "text": text + " " + name}) + "\n")
        ingest.ingest(spark, str(src), str(tmp_path / "i"), str(tmp_path / "cp")).awaitTermination(60)
    idx = ingest.streamed_index(spark, str(tmp_path / "i"))
    assert idx.meta.count() == 2 and idx.meta.select("segment_id").distinct().count() == 2
    assert search.search_text(text, idx, profile="G").count() == 2
