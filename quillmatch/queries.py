"""Registered queries of the overlap engine with their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions import jsonops as J
from .functions import text as T
from .operators import catalog, index, search, segments
from .operators.index import GROUP
from .plans.config import SearchConfig

CONFIG = SearchConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _bench(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- SQL fragments ---------------------------------------------------------------

_Q = lambda t: t.replace("'", "''")
SQL_NORM = f"trim(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '{_Q(T._UP)}', '{_Q(T._LOW)}'), '[^_0-9a-z\\x{{0400}}-\\x{{04FF}}]+', ' ', 'g'))"
SQL_TOKENS = f"list_filter(string_split({SQL_NORM}, ' '), lambda w: w <> '')"
SQL_BASE = f"""
with toks as (select doc_id, source, {SQL_TOKENS} as w from documents),
meta as (select doc_id, source, len(w) as tok_len, w from toks where len(w) >= 9),
post as (select distinct doc_id, tok_len, unnest(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i + 8], ' '))) as g from meta),
qt as (select item_id as query_id, {SQL_TOKENS} as w from benchmark),
terms as (select distinct query_id, unnest(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i + 8], ' '))) as g from qt where len(w) >= 9),
df as (select g, count(*) as df from post group by g)"""
SQL_SCORE = "0.9::double * (0.6::double * j9 + (1.0::double - 0.6::double) * c9)"


def _sql_search(limit: str = "", top: int = 10) -> str:
    return SQL_BASE + f"""
, ranked as (select query_id, t.g, df, row_number() over (partition by query_id order by df, t.g) as rk from terms t join df using (g) where df <= 200000),
kept as (select * from ranked {limit}),
sz as (select query_id, count(*) as q from kept group by query_id),
seed as (select query_id, g from ranked where rk <= 64),
cand as (select query_id, doc_id, count(*) as cand_hits from seed join post using (g) group by all),
inter as (select query_id, doc_id, max(tok_len) as tok_len, count(*) as i from kept join post using (g) group by query_id, doc_id),
s as (select query_id, doc_id, i::double / (q + tok_len - 8 - i) as j9, i::double / q as c9, cand_hits from inter join sz using (query_id) join cand using (query_id, doc_id)),
r as (select *, {SQL_SCORE} as score from s),
o as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r)
select query_id, doc_id, round(score, 9) as score, round(j9, 9) as j9, round(c9, 9) as c9, cand_hits, rank,
  case when score >= 0.7 then 'plagiarism' when score >= 0.3 then 'partial' else 'original' end as decision,
  round((1 - greatest(0, least(1, score))) * 100, 1) as originality_pct
from o where rank <= {top}"""


def _shown(hits: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return hits.select("query_id", "doc_id", r("score"), r("j9"), r("c9"), "cand_hits", "rank", "decision", "originality_pct")


def search_segment_profile(s, d):
    return _shown(search.search(_bench(s, d), _docs(s, d), CONFIG, "G"))


def search_monolith_profile(s, d):
    return _shown(search.search(_bench(s, d), _docs(s, d), CONFIG, "M"))


def norm_text(s, d):
    return _docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("norm"))


def token_counts(s, d):
    return T.with_tokens(_docs(s, d)).select("doc_id", F.size("words").alias("tok_len"), F.size(F.array_distinct("words")).alias("distinct_tokens"))


def doc_meta(s, d):
    return index.build(_docs(s, d)).meta.select("doc_id", "tok_len")


def rejected_docs(s, d):
    return index.rejected(_docs(s, d))


def index_stats(s, d):
    return index.stats(_docs(s, d))


def index_validate(s, d):
    return index.validate(index.build(_docs(s, d)))


def shingle_df_histogram(s, d):
    docs = _docs(s, d)
    return index.frequencies(index.build(docs).postings, docs, GROUP, "key").groupBy("df").agg(F.count("*").alias("shingles"))


def seeds_rare_first(s, d):
    terms = search.query_terms(_bench(s, d))
    ranked = search.ranked_terms(terms, search.touched(_docs(s, d), terms), CONFIG, "G")
    return search.seeds(ranked, CONFIG).groupBy("query_id").agg(F.count("*").alias("seeds"), F.sum("df").alias("df_sum"), F.max("df").alias("max_df"))


def seed_budget(s, d):
    """A small budget of postings: each query stops at its first overflow."""
    config = replace(CONFIG, max_df_sum=12)
    terms = search.query_terms(_bench(s, d))
    ranked = search.ranked_terms(terms, search.touched(_docs(s, d), terms), config, "G")
    return search.seeds(ranked, config).groupBy("query_id").agg(F.count("*").alias("seeds"), F.sum("df").alias("df_sum"))


def candidate_hits(s, d):
    terms = search.query_terms(_bench(s, d))
    idx = search.touched(_docs(s, d), terms)
    return search.candidates(search.seeds(search.ranked_terms(terms, idx, CONFIG, "G"), CONFIG), idx, CONFIG).select("query_id", "doc_id", "cand_hits")


def decision_counts(s, d):
    hits = search.search(_bench(s, d), _docs(s, d), CONFIG, "G")
    return hits.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("avg_score"))


def allow_list(s, d):
    """Hits cut to documents labelled as good, after the cut to ten."""
    good = table(s, d, "labels").where("quality = 1").select("doc_id")
    return _shown(search.search(_bench(s, d), _docs(s, d), CONFIG, "G", good))


def exact_duplicates(s, d):
    own = _docs(s, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("k"))
    return own.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").select("first_doc", "copies")


# --- shards and segments -----------------------------------------------------------


def _catalog(s, d):
    """Documents as catalog rows: shard by owner, all waiting for a segment."""
    own = table(s, d, "documents").select("doc_id", "source", "lang")
    key = H.owner_key(F.col("source"), F.col("lang"), F.lit(""))
    return own.select("doc_id", H.shard_md5(key, 8).alias("shard_id"), F.lit(None).cast("long").alias("segment_id"), F.lit("etl_ok").alias("status"))


def _no_segments(s):
    return s.createDataFrame([], "segment_id long, shard_id int, level int, status string, doc_count long")


SQL_SHARD = "(('0x' || substr(md5(coalesce(source, '') || '|' || coalesce(lang, '') || '|'), 1, 16))::uhugeint % 8)::int"
SQL_L1 = f"""
with own as (select doc_id, {SQL_SHARD} as shard_id from documents),
b as (select doc_id, shard_id, (row_number() over (partition by shard_id order by doc_id) - 1) // 10 as batch from own),
made as (select shard_id, batch, count(*) as doc_count, row_number() over (order by shard_id, batch) as segment_id from b group by shard_id, batch)"""


def shard_md5(s, d):
    return _catalog(s, d).groupBy("shard_id").agg(F.count("*").alias("docs"))


def shard_crc32(s, d):
    key = H.owner_key(F.col("source"), F.col("lang"), F.lit(""))
    return table(s, d, "documents").select("doc_id", H.shard_crc32(key, 8).alias("shard_id"))


#: CRC-32 bit by bit over the few distinct owner keys.
SQL_CRC32 = """
with own as (select doc_id, coalesce(source, '') || '|' || coalesce(lang, '') || '|' as key from documents),
b as (select key, hex(encode(key)) as h, octet_length(encode(key)) as n from (select distinct key from own)),
x as (select key, list_transform(range(1, n + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint) as bytes from b),
c as (select key, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda r, v: list_reduce(list_prepend(xor(r, v), range(8)), lambda y, i: xor(y >> 1, 3988292384::bigint * (y & 1)))), 4294967295::bigint) as crc from x)
select doc_id, (crc % 8)::int as shard_id from own join c using (key)"""


def l1_assignment(s, d):
    return segments.assign_level1(_catalog(s, d))


def segment_catalog(s, d):
    return segments.build_level1(_catalog(s, d), _no_segments(s))[1]


def compacted_catalog(s, d):
    return segments.compact(*segments.build_level1(_catalog(s, d), _no_segments(s)), 1)[1]


def catalog_status(s, d):
    return catalog.status(*segments.build_level1(_catalog(s, d), _no_segments(s)))


def shards_to_compact(s, d):
    return catalog.shards_with_ready(segments.build_level1(_catalog(s, d), _no_segments(s))[1], 1, 10)


def levels_dense_rank(s, d):
    segs = segments.compact(*segments.build_level1(_catalog(s, d), _no_segments(s)), 1)[1]
    return segments.first_levels(segs, 1).groupBy("level").agg(F.count("*").alias("segments"))


def base_pending(s, d):
    docs = _catalog(s, d).withColumn("status", F.lit("l5_uploaded"))
    held = table(s, d, "labels").select("doc_id")
    return segments.pending_base(docs, held).select("doc_id", "shard_id")


def _by_source(s, d):
    return table(s, d, "documents").select("doc_id", "text", F.substring("source", 4, 8).cast("int").alias(GROUP))


def cross_segment_merge(s, d):
    hits = search.search_segments(_bench(s, d), _by_source(s, d))
    return hits.select("query_id", "doc_id", "best_segment", F.round("score", 9).alias("score"), F.round("j9", 9).alias("j9"), F.round("c9", 9).alias("c9"), "cand_hits", "found_in", "rank")


SQL_MERGE = f"""
with toks as (select doc_id, substr(source, 4)::int as seg, {SQL_TOKENS} as w from documents),
meta as (select doc_id, seg, len(w) as tok_len, w from toks where len(w) >= 9),
post as (select distinct doc_id, seg, tok_len, unnest(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i + 8], ' '))) as g from meta),
qt as (select item_id as query_id, {SQL_TOKENS} as w from benchmark),
terms as (select distinct query_id, unnest(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i + 8], ' '))) as g from qt where len(w) >= 9),
df as (select seg, g, count(*) as df from post group by all),
ranked as (select query_id, seg, g, row_number() over (partition by query_id, seg order by df, g) as rk from terms join df using (g)),
sz as (select query_id, seg, count(*) as q from ranked group by all),
cand as (select query_id, seg, doc_id, count(*) as cand_hits from ranked join post using (seg, g) where rk <= 64 group by all),
inter as (select query_id, seg, doc_id, max(tok_len) as tok_len, count(*) as i from ranked join post using (seg, g) group by query_id, seg, doc_id),
s as (select query_id, seg, doc_id, i::double / (q + tok_len - 8 - i) as j9, i::double / q as c9, cand_hits from inter join sz using (query_id, seg) join cand using (query_id, seg, doc_id)),
r as (select *, {SQL_SCORE} as score from s),
m as (select query_id, doc_id, arg_max(seg, score) as best_segment, max(score) as score, arg_max(j9, score) as j9, arg_max(c9, score) as c9, max(cand_hits) as cand_hits, count(distinct seg) as found_in from r group by all),
o as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m)
select query_id, doc_id, best_segment, round(score, 9) as score, round(j9, 9) as j9, round(c9, 9) as c9, cand_hits, found_in, rank from o where rank <= 10"""


# --- sketches ------------------------------------------------------------------------


def _signed(s, d):
    words = T.with_tokens(_docs(s, d))
    keys = words.where(F.size("words") >= T.K).select("doc_id", F.array_distinct(T.shingle_keys("words")).alias("keys"))
    return keys.select("doc_id", H.minhash_udf()("keys").alias("signature"))


def minhash_signatures(s, d):
    return _signed(s, d).select("doc_id", F.sha1(F.array_join("signature", ",").cast("binary")).alias("signature_sha1"))


def lsh_candidates(s, d):
    return H.lsh_candidates(_signed(s, d))


def simhash128(s, d):
    own = T.with_tokens(_docs(s, d)).select("doc_id", H.simhash128("words").alias("h"))
    return own.select("doc_id", F.col("h.hi").alias("simhash_hi"), F.col("h.lo").alias("simhash_lo"))


def fnv_tokens(s, d):
    """FNV-1a of the first shingle of each document."""
    words = T.with_tokens(_docs(s, d)).where(F.size("words") >= T.K)
    return words.select("doc_id", H.fnv1a64(F.array_join(F.slice("words", 1, T.K), " ")).alias("h"))


SQL_FNV = f"""with t as (select doc_id, {SQL_TOKENS} as w from documents), g as (select doc_id, encode(array_to_string(w[1:9], ' ')) as b from t where len(w) >= 9),
x as (select doc_id, list_reduce(list_prepend({H.FNV_BASIS}::uhugeint, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || substr(hex(b), 2 * i - 1, 2))::uhugeint)), lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as u from g)
select doc_id, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end as h from x"""


def sha1_shingles(s, d):
    """SHA-1 key of the first five-word window of each document."""
    words = T.with_tokens(_docs(s, d)).where(F.size("words") >= 5)
    return words.select("doc_id", H.sha1_key(F.array_join(F.slice("words", 1, 5), " ")).cast("string").alias("k"))


def _windows(s, d, k):
    """doc_id, position, window: every k-word window of each document."""
    return T.each_window(T.with_tokens(_docs(s, d)), k).select("doc_id", "position", F.array_join(T.window_words(k), " ").alias("window"))


def fnv_windows(s, d):
    """FNV-1a of every shingle of each document."""
    return _windows(s, d, T.K).select("doc_id", "position", H.fnv1a64("window").alias("h"))


def sha1_windows(s, d):
    """SHA-1 key of every five-word window of each document."""
    return _windows(s, d, 5).select("doc_id", "position", H.sha1_digits(F.col("window")).alias("k"))


# --- other text functions -------------------------------------------------------------


def norm_for_local(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.norm_for_local(F.col("text"))).alias("h"))


def pdf_cleanup(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.pdf_cleanup(F.col("text"))).alias("h"))


def alpha_density(s, d):
    return _docs(s, d).select("doc_id", F.round(T.alpha_density(F.col("text")), 9).alias("density"))


def nfkc_lower(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.nfkc_lower("text")).alias("h"))


def normalize_wide(s, d):
    own = _docs(s, d).select("doc_id", T.normalize_wide("text").alias("t"))
    return own.select("doc_id", F.size(F.split("t", " ")).alias("words"), F.md5("t").alias("h"))


def html_text(s, d):
    return table(s, d, "pages").select("page_id", T.html_text("html").alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("h"))


# --- JSON -----------------------------------------------------------------------------


def _props(s, d):
    return table(s, d, "events")


def json_pointer(s, d):
    return _props(s, d).select("event_id", J.at_pointer(F.col("props"), "/k", "long").alias("k"), J.at_pointer(F.col("props"), "/missing/0", "long").alias("missing"))


def json_keys(s, d):
    return _props(s, d).select("event_id", F.array_join(J.keys(F.col("props")), ",").alias("keys"), J.n_fields(F.col("props")).alias("n"))


def json_types(s, d):
    return _props(s, d).groupBy(J.type_tag(F.col("props")).alias("type"), J.type_tag(J.first_field(F.col("props"), "k")).alias("k_type")).agg(F.count("*").alias("n"))


def json_valid(s, d):
    return _props(s, d).select("event_id", J.is_valid("props").alias("ok"), J.is_valid(F.concat("props", F.lit(" x"))).alias("with_tail"))


def json_minify(s, d):
    return _props(s, d).select("event_id", J.minify("props").alias("small"))


def json_stats(s, d):
    return _props(s, d).select("event_id", J.stats("props").alias("j")).agg(F.sum("j.objects").alias("objects"), F.sum("j.keys").alias("keys"), F.sum("j.key_bytes").alias("key_bytes"), F.sum("j.integers").alias("integers"), F.max("j.depth").alias("depth"))


def json_msgpack(s, d):
    return _props(s, d).select("event_id", F.hex(J.to_msgpack("props")).alias("packed"))


def json_partial(s, d):
    """Nested fields of an array of objects, missing numbers as 0."""
    own = table(s, d, "orders")
    docs = own.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("s")).alias("st"), "o_totalprice"))).alias("j"))
    rows = docs.select("o_custkey", F.explode(F.from_json("j", "array<struct<o_orderkey: bigint, st: struct<s: string>, o_totalprice: double, retweets: bigint>>")).alias("x"))
    return rows.select("o_custkey", "x.o_orderkey", F.col("x.st.s").alias("status"), F.round("x.o_totalprice", 2).alias("total"), F.coalesce("x.retweets", F.lit(0)).alias("retweets"))


def json_top(s, d):
    """The largest k up to 60 by event type; the later event wins a tie."""
    own = _props(s, d).select("event_type", "event_id", J.at_pointer(F.col("props"), "/k", "long").alias("k")).where("k <= 60")
    return own.groupBy("event_type").agg(F.max_by(F.struct("event_id", "k"), F.struct("k", "event_id")).alias("b")).select("event_type", "b.event_id", "b.k")


def json_find(s, d):
    return _props(s, d).where("event_id = 505").select("event_id", J.at_pointer(F.col("props"), "/k", "long").alias("k")).limit(1)


def json_distinct_ids(s, d):
    """Distinct ids over two paths."""
    e = _props(s, d)
    return e.select(F.col("user_id").alias("id")).unionAll(e.select(J.at_pointer(F.col("props"), "/k", "long").alias("id"))).where("id is not null").distinct()


def json_brand_sum(s, d):
    """Weighted and plain sums by the first element of JSON rows, the header left out."""
    own = table(s, d, "part").select(F.to_json(F.array(F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))).alias("line"))
    f = lambda i: J.element(F.col("line"), i)
    rows = own.select(f(0).alias("brand"), f(1).cast("long").alias("n"), f(2).cast("double").alias("price")).where("brand <> 'brand'")
    return rows.groupBy("brand").agg(F.round(F.sum(F.col("n") * F.col("price")), 2).alias("weighted"), F.sum("n").alias("reviews"))


def json_points(s, d):
    """Numbers of an array of objects."""
    own = table(s, d, "embeddings").select("vec_id", F.to_json(F.struct(F.expr("slice(embedding, 1, 3)").alias("p"))).alias("j"))
    return own.select("vec_id", *[J.at_pointer(F.col("j"), f"/p/{i}", "double").cast("float").cast("double").alias(c) for i, c in enumerate("xyz")])


#: Nested, escaped, repeated, spaced and broken JSON made of the columns of events; the same expression in both dialects.
SQL_MIXED = """case event_id % 8
 when 0 then concat('{"a":{"b/c":[', event_id, ',', user_id, ',"x"]},"k":null}')
 when 1 then concat('[', event_id, ',true,{"t":"', event_type, '"}]')
 when 2 then concat('{"k":', event_id, ',"k":', user_id, '}')
 when 3 then concat('{"k":', event_id)
 when 4 then concat('"', event_type, ' q"')
 when 5 then concat(' { "t" : "a  b" , "k" : ', event_id, ' , "n" : -', event_id, '.5 } ')
 when 6 then concat('[1,2', event_type)
 else concat('{"k":', event_id, '} x') end"""


def _mixed(s, d):
    return table(s, d, "events").select("event_id", F.expr(SQL_MIXED).alias("j"))


def json_mixed(s, d):
    """Validity, type, key lookup and pointers over nested and broken JSON; a text with a repeated key has no type, one with more behind its first value has that value's."""
    j = F.col("j")
    return _mixed(s, d).select(
        "event_id", J.is_valid("j").alias("ok"), J.type_tag(j).alias("type"), J.at_pointer(j, "/a/b~1c/1", "long").alias("deep"), J.at_pointer(j, "/2/t", "string").alias("third"), J.at_pointer(j, "/n", "double").alias("n"), F.md5(J.minify("j")).alias("small")
    )


def json_mixed_stats(s, d):
    own = _mixed(s, d).where("event_id % 8 in (0, 1, 4, 5)").select((F.col("event_id") % 8).alias("kind"), J.stats("j").alias("s"))
    names = "objects arrays strings integers floats trues nulls keys key_bytes".split()
    return own.groupBy("kind").agg(*[F.sum(f"s.{n}").alias(n) for n in names], F.max("s.depth").alias("depth"))


SQL_JSON_MIXED = f"""
with m as (select event_id, {SQL_MIXED} as j from events), v as (select *, json_valid(j) as ok from m)
select event_id, ok,
 case when event_id % 8 = 7 then 'object' when not ok or event_id % 8 = 2 then null else case json_type(case when ok then j end) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' end end as type,
 case when ok then json_extract_string(case when ok then j end, '/a/b~1c/1')::bigint end as deep, case when ok then json_extract_string(case when ok then j end, '/2/t') end as third,
 case when ok then json_extract_string(case when ok then j end, '/n')::double end as n,
 md5(case when event_id % 8 = 5 then replace(replace(replace(replace(trim(j), ' : ', ':'), ' , ', ','), '{{ ', '{{'), ' }}', '}}') when ok then j end) as small from v"""
SQL_MIXED_STATS = """
with m as (select event_id % 8 as kind, count(*) as c from events where event_id % 8 in (0, 1, 4, 5) group by all)
select kind, c * case kind when 0 then 2 when 1 then 1 when 4 then 0 else 1 end as objects, c * case kind when 0 then 1 when 1 then 1 else 0 end as arrays, c * case kind when 0 then 1 when 1 then 1 when 4 then 1 else 1 end as strings,
 c * case kind when 0 then 2 when 1 then 1 when 4 then 0 else 1 end as integers, c * case kind when 5 then 1 else 0 end as floats, c * case kind when 1 then 1 else 0 end as trues, c * case kind when 0 then 1 else 0 end as nulls,
 c * case kind when 0 then 3 when 1 then 1 when 4 then 0 else 3 end as keys, c * case kind when 0 then 5 when 1 then 1 when 4 then 0 else 3 end as key_bytes, case kind when 0 then 4 when 1 then 3 when 4 then 1 else 2 end as depth from m"""


def utf8_valid(s, d):
    return _docs(s, d).groupBy(F.is_valid_utf8("text").alias("ok")).agg(F.count("*").alias("n"))


def event_window_counts(s, d):
    from .streaming.ingest import event_counts

    return event_counts(table(s, d, "events"))


# --- relational ----------------------------------------------------------------------


def docs_in_labels(s, d):
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    return docs.where(F.col("lang").isin("en", "de")).join(lab.where("toxic = 0"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def docs_not_in_labels(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def sources_having(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 10")


def newest_by_source(s, d):
    own = table(s, d, "documents").select("doc_id", "source")
    return own.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("r <= 3")


QUERIES = {
    f.__name__: f
    for f in (
        search_segment_profile, search_monolith_profile, norm_text, token_counts, doc_meta, rejected_docs, index_stats, index_validate, shingle_df_histogram,
        seeds_rare_first, seed_budget, candidate_hits, decision_counts, allow_list, exact_duplicates, shard_md5, shard_crc32, l1_assignment, segment_catalog,
        compacted_catalog, catalog_status, shards_to_compact, levels_dense_rank, base_pending, cross_segment_merge, minhash_signatures, lsh_candidates, simhash128,
        fnv_tokens, sha1_shingles, fnv_windows, sha1_windows, norm_for_local, pdf_cleanup, alpha_density, nfkc_lower, normalize_wide, html_text, json_pointer, json_keys, json_types, json_valid, json_mixed, json_mixed_stats,
        json_minify, json_stats, json_msgpack, json_partial, json_top, json_find, json_distinct_ids, json_brand_sum, json_points, utf8_valid, event_window_counts,
        docs_in_labels, docs_not_in_labels, sources_having, newest_by_source,
    )
}

_TOKS = f"with t as (select doc_id, {SQL_TOKENS} as w from documents)"
ORACLES = {
    "json_mixed": SQL_JSON_MIXED,
    "json_mixed_stats": SQL_MIXED_STATS,
    "shard_crc32": SQL_CRC32,
    "search_segment_profile": _sql_search(),
    "search_monolith_profile": _sql_search("where rk <= 256"),
    "norm_text": f"select doc_id, {SQL_NORM} as norm from documents",
    "token_counts": f"{_TOKS} select doc_id, len(w)::int as tok_len, len(list_distinct(w))::int as distinct_tokens from t",
    "doc_meta": f"{_TOKS} select doc_id, len(w)::int as tok_len from t where len(w) >= 9",
    "rejected_docs": f"{_TOKS} select doc_id, len(w)::int as tok_len from t where len(w) < 9",
    "index_stats": SQL_BASE + " select (select count(*) from toks) as lines_total, (select count(*) from meta) as docs_ok, (select count(*) from toks) - (select count(*) from meta) as docs_bad, (select sum(tok_len - 8) from meta)::bigint as pairs_before_dedup, (select count(*) from df) as shingles, (select count(*) from post) as postings, (select max(df) from df) as max_df",
    "index_validate": "select 0::bigint as repeated_postings, 0::bigint as postings_without_document, 0::bigint as short_documents, 0::bigint as repeated_documents",
    "shingle_df_histogram": SQL_BASE + " select df, count(*) as shingles from df group by df",
    "seeds_rare_first": SQL_BASE + " , r as (select query_id, df, row_number() over (partition by query_id order by df, g) as rk from terms join df using (g)) select query_id, count(*) as seeds, sum(df)::bigint as df_sum, max(df) as max_df from r where rk <= 64 group by query_id",
    "seed_budget": SQL_BASE + " , r as (select query_id, df, row_number() over (partition by query_id order by df, g) as rk, sum(df) over (partition by query_id order by df, g rows unbounded preceding) as cum from terms join df using (g)) select query_id, count(*) as seeds, sum(df)::bigint as df_sum from r where rk <= 64 and (cum <= 12 or rk = 1) group by query_id",
    "candidate_hits": SQL_BASE + " , r as (select query_id, g, row_number() over (partition by query_id order by df, g) as rk from terms join df using (g)) select query_id, doc_id, count(*) as cand_hits from r join post using (g) where rk <= 64 group by all",
    "decision_counts": f"select decision, count(*) as n, round(avg(score), 9) as avg_score from ({_sql_search().replace('round(score, 9) as score', 'score as score')}) group by decision",
    "allow_list": f"select * from ({_sql_search()}) where doc_id in (select doc_id from labels where quality = 1)",
    "exact_duplicates": f"select min(doc_id) as first_doc, count(*) as copies from (select doc_id, {SQL_NORM} as n from documents) group by n having count(*) > 1",
    "shard_md5": f"select {SQL_SHARD} as shard_id, count(*) as docs from documents group by 1",
    "l1_assignment": SQL_L1 + " select shard_id, batch, doc_id from b",
    "segment_catalog": SQL_L1 + " select segment_id, shard_id, 1 as level, 'ready' as status, doc_count from made",
    "compacted_catalog": SQL_L1 + """, p as (select *, (row_number() over (partition by shard_id order by segment_id) - 1) // 10 as pack, count(*) over (partition by shard_id) as n_all from made),
full_ as (select * from p where (pack + 1) * 10 <= n_all), top as (select max(segment_id) as t from made)
select segment_id, shard_id, 1 as level, case when segment_id in (select segment_id from full_) then 'merged' else 'ready' end as status, doc_count from made
union all select (select t from top) + row_number() over (order by shard_id, pack), shard_id, 2, 'ready', sum(doc_count)::bigint from full_ group by shard_id, pack""",
    "catalog_status": SQL_L1 + " select 0::bigint as level0_docs, 0::bigint as l5_docs, count(*) as ready_l1, 0::bigint as ready_l2, 0::bigint as ready_l3, 0::bigint as ready_l4 from made",
    "shards_to_compact": SQL_L1 + " select shard_id, count(*) as n from made group by shard_id having count(*) >= 10",
    "levels_dense_rank": SQL_L1 + """, p as (select *, (row_number() over (partition by shard_id order by segment_id) - 1) // 10 as pack, count(*) over (partition by shard_id) as n_all from made)
select 1 as level, count(*) as segments from p where (pack + 1) * 10 > n_all""",
    "base_pending": f"select doc_id, {SQL_SHARD} as shard_id from documents where doc_id not in (select doc_id from labels)",
    "cross_segment_merge": SQL_MERGE,
    "fnv_tokens": SQL_FNV,
    "sha1_shingles": f"{_TOKS} select doc_id, (('0x' || substr(sha1(array_to_string(w[1:5], ' ')), 1, 16))::uhugeint)::varchar as k from t where len(w) >= 5",
    "sha1_windows": f"{_TOKS}, x as (select doc_id, w, unnest(range(0, len(w) - 4)) as p from t where len(w) >= 5) select doc_id, p::int as position, (('0x' || substr(sha1(array_to_string(w[p + 1:p + 5], ' ')), 1, 16))::uhugeint)::varchar as k from x",
    "norm_for_local": "select doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яёіқғңөұүһ0-9ſı ]', ' ', 'g'), ' +', ' ', 'g'))) as h from documents",
    "alpha_density": r"select doc_id, round(case when length(text) > 0 then length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / length(text) else 0 end, 9) as density from documents",
    "json_pointer": "select event_id, (props->>'$.k')::bigint as k, null::bigint as missing from events",
    "json_keys": "select event_id, array_to_string(json_keys(props), ',') as keys, len(json_keys(props))::int as n from events",
    "json_types": "select 'object' as type, 'int64' as k_type, count(*) as n from events",
    "json_valid": "select event_id, json_valid(props) as ok, false as with_tail from events",
    "json_minify": "select event_id, replace(props, ' ', '') as small from events",
    "json_stats": "select count(*)::bigint as objects, count(*)::bigint as keys, count(*)::bigint as key_bytes, count(*)::bigint as integers, 2::bigint as depth from events",
    "json_partial": "select o_custkey, o_orderkey, o_orderstatus as status, round(o_totalprice, 2) as total, 0::bigint as retweets from orders",
    "json_top": "with e as (select event_type, event_id, (props->>'$.k')::bigint as k from events), r as (select *, row_number() over (partition by event_type order by k desc, event_id desc) as n from e where k <= 60) select event_type, event_id, k from r where n = 1",
    "json_find": "select event_id, (props->>'$.k')::bigint as k from events where event_id = 505",
    "json_distinct_ids": "select user_id as id from events union select (props->>'$.k')::bigint from events",
    "json_brand_sum": "select p_brand as brand, round(sum(p_size * p_retailprice), 2) as weighted, sum(p_size)::bigint as reviews from part group by p_brand",
    "json_points": "select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings",
    "utf8_valid": "select true as ok, count(*) as n from documents",
    "event_window_counts": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all",
    "docs_in_labels": "select lang, count(*) as n, count(distinct source) as sources from documents where lang in ('en', 'de') and doc_id in (select doc_id from labels where toxic = 0) group by lang",
    "docs_not_in_labels": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "sources_having": "select source, count(*) as n from documents group by source having count(*) >= 10",
    "newest_by_source": "with r as (select doc_id, source, row_number() over (partition by source order by doc_id desc) as r from documents) select doc_id, source, r::int as r from r where r <= 3",
}
