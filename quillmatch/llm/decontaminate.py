"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words are kept, numbers, names and units become typed placeholders, so a
question with other figures or names has the same template. Windows of
``window`` template words of all texts meet the benchmark's windows by hash.
The benchmark's windows are broadcast after their bytes have been counted and
found below ``max_broadcast``; beyond that the join shuffles. A text that holds
at least ``min_share`` of an item's windows, or ``min_windows`` of them, is a
candidate; for candidates alone, the values in the slots are compared: along one
alignment of text and item, each value of the item must stand for one value of
the text; each further value is a conflict, and conflicts may be
``max_conflicts`` of the slots at most.

A name is a capitalised word in mid-sentence; a unit follows a number; several
names or numbers in a row are one placeholder, so "New York" stands for "Paris"
and "twenty one" for "21". Windows of the benchmark with fewer than
``min_literal`` plain words are not used, unless an item has no others: then a
text must hold all of them with the item's own values. Items shorter than the
window are searched by windows of their own length; items below ``MIN_WORDS``
template words are not searched.

Defined results: null or empty texts hold no windows; null ids of texts or items
are kept as they are; repeated rows of either table do not change the result,
which has one row for each pair of text and item; an empty table on either side
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, stash, table

WINDOW = 8
MIN_SHARE = 0.4
MIN_WINDOWS = 16
MIN_LITERAL = 4
MIN_WORDS = 3
MAX_CONFLICTS = 0.2
#: Bytes of windows that may be broadcast.
MAX_BROADCAST = 32_000_000
#: Words of a run of names or numbers that count as its value.
RUN = 5
UNITS = (
    "% € $ £ ° percent km cm mm m kg mg g lb lbs oz l ml mph kmh hour hours minute minutes second seconds day days week weeks month months year years mile miles"
    " meter meters metre metres foot feet inch inches dollar dollars euro euros cent cents pound pounds gram grams litre litres liter liters degree degrees"
    " stunde stunden minuten tag tage jahr jahre heure heures jour jours an ans hora horas día días año años"
).split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve dozen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
_TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*|[%€$£°]|[.!?\n]+"
_ENDS = (".", "!", "?", "\n")


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with one more column that is computed once for each row, however often it is used."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def templates(df: DataFrame, values: bool = False) -> DataFrame:
    """text becomes t, the array of template words, or with ``values`` w, an array of (t, v): the template word and what stood there."""
    words = _once(df, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKEN), F.lit(0)), "words").drop("text")
    digit = lambda x: (x >= "0") & (x < ":")
    end = lambda y: F.substring(y, 1, 1).isin(*_ENDS)

    def canon(x: Column, i: Column) -> Column:
        low, before = F.lower(x), F.get("words", i - 1)
        return (
            F.when((x >= "a") & ~x.isin(*NUMBERS, *UNITS) & (low == x), x)  # most words: the same as what follows, sooner
            .when(digit(x) | low.isin(*NUMBERS), "<num>")
            .when(low.isin(*UNITS) & (digit(before) | F.lower(before).isin(*NUMBERS)), "<unit>")
            .when(low == x, F.when(end(x), "").otherwise(x))
            .when((i > 0) & ~end(before) & x.rlike(r"^\p{Lu}\p{Ll}+$"), "<name>")
            .otherwise(low)
        )

    # "" is the end of a sentence; it ends a run of placeholders
    keep = lambda t, before: (t != "") & ~((t >= "<") & (t < "=") & F.coalesce(t == before, F.lit(False)))
    typed = _once(words, F.transform("words", canon), "typed")
    if not values:
        return _once(typed, F.filter("typed", lambda t, i: keep(t, F.get("typed", i - 1))), "t").drop("words", "typed")
    run = lambda t, i: F.concat_ws(" ", *[F.when(F.forall(F.slice("typed", i + 1, k), lambda y: y == t), F.lower(F.get("words", i + k - 1))) for k in range(1, RUN + 1)])
    pairs = F.transform("typed", lambda t, i: F.struct(t.alias("t"), F.when((t >= "<") & (t < "="), run(t, i)).otherwise(F.lower(F.get("words", i))).alias("v"), F.get("typed", i - 1).alias("before")))
    out = _once(typed, F.filter(pairs, lambda w: keep(w["t"], w["before"])), "w").drop("words", "typed")
    return out.withColumn("w", F.expr("transform(w, x -> named_struct('t', x.t, 'v', x.v))"))


def _windows(words: str, size: int) -> Column:
    """Hashes of all windows of ``size`` words of the array column ``words``."""
    return F.expr(f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64(slice({words}, i + 1, {size}))) else array() end")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, min_literal: int = MIN_LITERAL, max_conflicts: float = MAX_CONFLICTS, max_broadcast: int = MAX_BROADCAST, min_windows: int = MIN_WINDOWS
) -> DataFrame:
    """doc_id, item_id, windows, share, slots, conflicts, exact of every text that holds an item.

    ``docs`` has doc_id and text, ``benchmark`` has item_id and text.
    """
    items = templates(pick(benchmark, "item_id", "text").distinct(), values=True).where(F.size("w") >= MIN_WORDS)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window))).withColumn("t", F.expr("w.t"))
    spots = items.select("item_id", "size", F.posexplode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("ipos", "part"))
    plain = F.size(F.filter("part", lambda w: ~F.startswith(w["t"], F.lit("<"))))
    spots = spots.select("item_id", "size", "ipos", F.expr("xxhash64(part.t)").alias("h"), F.expr("part.v").alias("ivals"), F.expr("part.t").alias("t"), (plain >= min_literal).alias("usable"))
    some = spots.groupBy("item_id").agg(F.max("usable").alias("some")).withColumnRenamed("item_id", "i2")
    spots = spots.join(some, F.col("item_id").eqNullSafe(F.col("i2"))).where("usable or not some").select("item_id", "size", "ipos", "h", "ivals", "t", F.expr("not some").alias("strict"))
    spots = stash(spots, "windows")
    text = F.aggregate(F.concat("ivals", "t"), F.lit(0), lambda n, x: n + F.octet_length(x) + 24)
    total = spots.agg(F.count("*").alias("n"), F.sum(text + 64).alias("bytes")).first()
    sizes = sorted(r["size"] for r in spots.select("size").distinct().collect())  # at most ``window`` numbers
    small = lambda df, size: F.broadcast(df) if size <= max_broadcast else df

    own = pick(docs, "doc_id", "text")
    words = templates(own)
    every = F.concat(*[_windows("t", k) for k in sizes]) if sizes else F.expr("cast(array() as array<bigint>)")
    hashes = words.select("doc_id", F.explode(every).alias("h"))
    hit = hashes.join(small(spots.select("h", "item_id").distinct(), 32 * total["n"]), "h").distinct()
    wanted = spots.select("item_id", "h", "strict").distinct().groupBy("item_id").agg(F.count("*").alias("n_item"), F.max("strict").alias("strict"))
    pairs = hit.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
    pairs = pairs.join(wanted.withColumnRenamed("item_id", "i2"), F.col("item_id").eqNullSafe(F.col("i2")))
    enough = F.when(F.col("strict"), F.col("windows") == F.col("n_item")).otherwise((F.col("windows") >= min_share * F.col("n_item")) | (F.col("windows") >= min_windows))
    pairs = stash(pairs.where(enough).select("doc_id", "item_id", "windows", (F.col("windows") / F.col("n_item")).alias("share"), "strict"), "pairs")

    # slots of candidates
    few = own.join(pairs.select(F.col("doc_id").alias("d2")).distinct(), F.col("doc_id").eqNullSafe(F.col("d2")), "left_semi").distinct()
    few = templates(few, values=True)
    slotted = spots.where(F.exists("t", lambda t: F.startswith(t, F.lit("<"))))
    if not slotted.limit(1).count():
        return pairs.select("doc_id", "item_id", "windows", "share", F.lit(0).cast("long").alias("slots"), F.lit(0).cast("long").alias("conflicts"), F.lit(True).alias("exact"))
    at = few.select("doc_id", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("size"), "w").where("size(w) >= size")
    at = at.select("doc_id", "size", F.posexplode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("pos", "part"))
    at = at.select("doc_id", "size", "pos", F.expr("xxhash64(part.t)").alias("h"), F.expr("part.v").alias("vals"))
    met = at.join(small(slotted.select("h", "size", "item_id", "ipos", "ivals", "t"), total["bytes"] or 0), ["h", "size"])
    value = met.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), F.explode(F.arrays_zip("t", "ivals", "vals")).alias("x")).where("startswith(x.t, '<')")
    value = value.groupBy("doc_id", "item_id", "shift", F.col("x.t").alias("t"), F.col("x.ivals").alias("iv")).agg(F.count_distinct("x.vals").alias("kinds"), F.min(F.col("x.vals") == F.col("x.ivals")).alias("same"))
    by = value.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("slots"), F.sum(F.col("kinds") - 1).alias("conflicts"), F.min("same").alias("exact"))
    best = by.groupBy(F.col("doc_id").alias("d2"), F.col("item_id").alias("i2")).agg(F.max_by(F.struct("slots", "conflicts", "exact"), F.struct(F.col("slots") - 2 * F.col("conflicts"), -F.col("shift"))).alias("b"))
    out = pairs.join(best, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("item_id").eqNullSafe(F.col("i2")), "left")
    out = out.select("strict", "doc_id", "item_id", "windows", "share", F.coalesce("b.slots", F.lit(0).cast("long")).alias("slots"), F.coalesce("b.conflicts", F.lit(0).cast("long")).alias("conflicts"), F.coalesce("b.exact", F.lit(True)).alias("exact"))
    return out.where(F.when(F.col("strict"), F.col("exact")).otherwise(F.col("conflicts") <= max_conflicts * F.col("slots"))).drop("strict")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
