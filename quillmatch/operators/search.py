"""Batch similarity search: rare shingles seed candidates, blended overlap ranks them.

Profile M treats the index as one and intersects with the 256 rarest terms of a
query; profile G works on each segment for itself and intersects with all terms.
Every cap is a window over the query's own terms or candidates.

The query side decides the plan. Its distinct keys are counted; up to
``BROADCAST_KEYS`` they are broadcast and the index's postings are cut by a
semi-join before anything is shuffled, beyond that the join shuffles by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.config import SearchConfig
from ..plans.shared import stash
from .index import GROUP, Index, tokenized

#: Distinct 64-bit keys that may be broadcast (some 40 MB in memory).
BROADCAST_KEYS = 2_000_000


def query_terms(queries: DataFrame, k: int = T.K) -> DataFrame:
    """query_id, key: the distinct shingles of each query, written once. ``queries`` has query_id and text."""
    words = T.with_tokens(queries.select("query_id", "text"))
    terms = words.where(F.size("words") >= k).select("query_id", F.explode(F.array_distinct(T.shingle_keys("words", k))).alias("key")).distinct()
    return stash(terms, "terms")


def touched(corpus: DataFrame, terms: DataFrame, k: int = T.K, broadcast_keys: int = BROADCAST_KEYS) -> Index:
    """The part of the corpus's index that the terms can meet, without building the rest: one scan of the corpus, written once."""
    words = T.each_window(tokenized(corpus), k)
    posts = words.select(GROUP, "doc_id", F.size("words").alias("tok_len"), F.xxhash64(T.window_words(k)).alias("key"))
    keys = terms.select("key").distinct()
    small = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    met = stash(posts.join(F.broadcast(keys) if small else keys, "key", "left_semi").distinct(), "touched")
    return Index(met.select(GROUP, "key", "doc_id"), met.select(GROUP, "doc_id", "tok_len").distinct())


def restrict(index: Index, terms: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> Index:
    """The postings of a stored index that the terms meet."""
    keys = terms.select("key").distinct()
    small = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    return Index(index.postings.join(F.broadcast(keys) if small else keys, "key", "left_semi"), index.meta)


def ranked_terms(terms: DataFrame, index: Index, config: SearchConfig, profile: str) -> DataFrame:
    """query_id, segment_id, key, df, rk, cum: terms by rarity with the running sum of their frequencies."""
    if profile == "M":  # the smallest keys are kept before the lookup
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
        terms = terms.withColumn("n", first).where(F.col("n") <= config.max_terms).drop("n")
    own = Window.partitionBy("query_id", GROUP).orderBy("df", "key")
    met = terms.join(index.df(), "key").where(F.col("df") <= config.max_df)
    met = met.withColumn("rk", F.row_number().over(own)).withColumn("cum", F.sum("df").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return met.where(F.col("rk") <= config.max_terms) if profile == "G" else met


def seeds(ranked: DataFrame, config: SearchConfig) -> DataFrame:
    """The rarest terms within the budget of postings; at least one."""
    budget = (F.col("cum") <= config.max_df_sum) | (F.col("rk") == 1) if config.max_df_sum else F.lit(True)
    return ranked.where((F.col("rk") <= config.fetch) & budget)


def candidates(seed: DataFrame, index: Index, config: SearchConfig) -> DataFrame:
    """query_id, segment_id, doc_id, cand_hits: the documents with most seeds."""
    hits = seed.select("query_id", GROUP, "key").join(index.postings, [GROUP, "key"]).groupBy("query_id", GROUP, "doc_id").agg(F.least(F.count("*"), F.lit(65535)).alias("cand_hits"))
    best = F.row_number().over(Window.partitionBy("query_id", GROUP).orderBy(F.desc("cand_hits"), "doc_id"))
    return hits.withColumn("n", best).where(F.col("n") <= config.max_candidates).drop("n")


def decision(score, config: SearchConfig):
    return F.when(score >= config.plagiarism, "plagiarism").when(score >= config.partial, "partial").otherwise("original")


def originality(score):
    """Percent of originality, one decimal."""
    return F.round((F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))) * 100, 1)


def search_index(terms: DataFrame, index: Index, config: SearchConfig | None = None, profile: str = "G") -> DataFrame:
    """query_id, segment_id, doc_id, score, j9, c9, cand_hits, rank: the top_k documents of each query and segment."""
    config = (config or SearchConfig()).clamped(profile)
    if config.top_k <= 0:
        raise ValueError("top_k must be positive")
    ranked = stash(ranked_terms(terms, index, config, profile), "ranked")
    kept = ranked.where(F.col("rk") <= config.rare_terms) if profile == "M" else ranked
    cand = candidates(seeds(ranked, config), index, config)
    sizes = kept.groupBy("query_id", GROUP).agg(F.count("*").alias("q"))
    inter = kept.select("query_id", GROUP, "key").join(index.postings, [GROUP, "key"]).groupBy("query_id", GROUP, "doc_id").agg(F.least(F.count("*"), F.lit(65535)).alias("i"))
    rows = inter.join(cand, ["query_id", GROUP, "doc_id"]).join(sizes, ["query_id", GROUP]).join(index.meta, [GROUP, "doc_id"])
    t = F.col("tok_len") - (config.k - 1)
    rows = rows.where((F.col("i") > 0) & (F.col("tok_len") >= config.min_doc_tokens) & (t > 0))
    j, c = F.col("i") / (F.col("q") + t - F.col("i")), F.col("i") / F.col("q")
    rows = rows.select("query_id", GROUP, "doc_id", (config.weight * (config.alpha * j + (1.0 - config.alpha) * c)).alias("score"), j.alias("j9"), c.alias("c9"), "cand_hits")
    place = F.row_number().over(Window.partitionBy("query_id", GROUP).orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= config.top_k)


def search(queries: DataFrame, corpus: DataFrame, config: SearchConfig | None = None, profile: str = "G", allow: DataFrame | None = None) -> DataFrame:
    """Search a corpus (doc_id, text[, segment_id]) with queries (query_id, text); adds decision and originality.

    ``allow`` (doc_id) filters after the cut to top_k, so fewer hits may remain.
    """
    config = config or SearchConfig()
    terms = query_terms(queries, config.k)
    index = touched(corpus, terms, config.k)
    return decided(search_index(terms, index, config, profile), config, allow)


def decided(hits: DataFrame, config: SearchConfig, allow: DataFrame | None = None) -> DataFrame:
    out = hits.withColumns({"decision": decision(F.col("score"), config), "originality_pct": originality(F.col("score"))})
    return out if allow is None else out.join(allow.select("doc_id").distinct(), "doc_id", "left_semi")


def search_text(text: str, index: Index, config: SearchConfig | None = None, profile: str = "M") -> DataFrame:
    """One text against a stored index; blank text gives no rows."""
    config = config or SearchConfig()
    spark = index.meta.sparkSession
    terms = query_terms(spark.createDataFrame([(0, text.strip())], "query_id long, text string"), config.k)
    return decided(search_index(terms, restrict(index, terms), config, profile), config)


def stage_stats(terms: DataFrame, index: Index, config: SearchConfig | None = None, profile: str = "G") -> DataFrame:
    """query_id and the rows of each stage: terms met, seeds, sum of frequencies, candidates."""
    config = (config or SearchConfig()).clamped(profile)
    ranked = ranked_terms(terms, index, config, profile)
    a = ranked.groupBy("query_id").agg(F.count("*").alias("terms"))
    b = seeds(ranked, config).groupBy("query_id").agg(F.count("*").alias("seeds"), F.sum("df").alias("df_sum"))
    c = candidates(seeds(ranked, config), index, config).groupBy("query_id").agg(F.count("*").alias("candidates"))
    return a.join(b, "query_id", "left").join(c, "query_id", "left")


def local_k(n_segments: int, top_k: int) -> int:
    """Hits to take from each segment before the merge."""
    times = 4 if n_segments <= 8 else 3 if n_segments <= 64 else 2 if n_segments <= 512 else 1
    return min(times * top_k, 8000)


def merge_segments(hits: DataFrame, top_k: int) -> DataFrame:
    """One row for each query and document over all segments.

    The best score wins, the earlier segment on a tie; ``found_in`` counts the
    segments; cand_hits is the largest at or after the winning segment.
    """
    best = F.max_by(F.struct("score", "j9", "c9", "cand_hits", GROUP), F.struct("score", -F.col(GROUP))).alias("b")
    by = hits.groupBy("query_id", "doc_id").agg(best, F.count_distinct(GROUP).alias("found_in"))
    later = hits.join(by.select("query_id", "doc_id", F.col(f"b.{GROUP}").alias("won")), ["query_id", "doc_id"]).where(F.col(GROUP) >= F.col("won")).groupBy("query_id", "doc_id").agg(F.max("cand_hits").alias("cand_hits"))
    out = by.join(later, ["query_id", "doc_id"]).select("query_id", "doc_id", F.col(f"b.{GROUP}").alias("best_segment"), "b.score", "b.j9", "b.c9", "cand_hits", "found_in")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= min(top_k, 2000))


def search_segments(queries: DataFrame, corpus: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """Search each segment for itself and merge. ``corpus`` has segment_id, doc_id, text."""
    config = config or SearchConfig()
    n = corpus.select(GROUP).distinct().count()
    from dataclasses import replace

    terms = query_terms(queries, config.k)
    hits = search_index(terms, touched(corpus, terms, config.k), replace(config, top_k=local_k(n, config.top_k)), "G")
    return merge_segments(hits, config.top_k)
