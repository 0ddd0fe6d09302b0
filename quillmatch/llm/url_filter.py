"""URL filters: a sort-merge range join of pages with nested host rules.

A host becomes its labels in reverse order, each followed by a dot
(``m.example.org`` -> ``org.example.m.``). A rule for a host and its subdomains
then covers one interval of keys, and such intervals are nested or disjoint.
Pages are dealt to ranges of (key, salt), so that a hot host spreads over
several ranges; a rule goes to each range that its interval touches. One sweep
over a sorted range keeps the stack of hosts whose intervals are open. A rule's
path holds below all subdomains of its host, which is no interval of keys, so
paths are no part of the key; each open host finds its longest fitting path by
the lengths of its paths.

Only the borders of the ranges come from a sample, as in Spark's own range
partitioning; every page and every rule is judged.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the default verdict; an empty host matches no rule. Rules with a null
host or path are ignored. Of two matching rules of equal length, the one with
the longer host wins, then block. Repeated pages give repeated results.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, pick, record, table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RULES_DDL = "host string, path string, verdict string"
#: Sampled keys for each range, at most about this many in all times the ranges.
SAMPLE_PER_RANGE = 64
OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url) -> tuple:
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.translate(raw_host, _AZ, _az)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return host, path


def host_key(host):
    """Labels in reverse order, each with a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Stack:
    """Hosts with rules whose intervals are open at the sweep's present key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        hosts: dict[str, tuple[str, dict[str, str]]] = {}
        for lo, host, path, verdict in rules:
            paths = hosts.setdefault(lo, (host, {}))[1]
            paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        # the paths of a host by their lengths, longest first: a page tries each length once, however many paths there are
        self.hosts = [(lo, host, paths, sorted({len(p) for p in paths}, reverse=True)) for lo, (host, paths) in sorted(hosts.items())]
        self.at, self.open = 0, []

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        while self.at < len(self.hosts) and self.hosts[self.at][0] <= key:
            own = self.hosts[self.at]
            while self.open and not own[0].startswith(self.open[-1][0]):
                self.open.pop()
            self.open.append(own)
            self.at += 1
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()
        found = None
        for _, host, paths, lengths in reversed(self.open):
            fit = next((path[:n] for n in lengths if path[:n] in paths and n <= len(path)), None)
            if fit is not None and (found is None or (len(host) + len(fit), len(host)) > found[0]):
                found = ((len(host) + len(fit), len(host)), host + fit, paths[fit])
        return found and found[1:]


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page.

    ``pages`` has page_id and url; ``rules`` has host, path and verdict.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = url_parts(F.col("url"))
    urls = pick(pages, "page_id", "url").select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("lo", host_key(F.col("host"))).withColumn("salt", F.hex(F.xxhash64("page_id", "path")))
    own = (
        pick(rules, "host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", _AZ, _az).alias("host"), "path", "verdict").withColumn("lo", host_key(F.col("host"))).where("lo <> ''").distinct()
    )
    total = urls.count()
    fraction = min(1.0, SAMPLE_PER_RANGE * n / max(1, total))
    drawn = sorted((r["lo"], r["salt"]) for r in urls.select("lo", "salt").sample(fraction, 7).collect())
    ranges = max(1, min(n, total // 500))
    borders = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if len(drawn) >= ranges else []
    los = [b[0] for b in borders]

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, salt = b.column("lo").to_pylist(), b.column("salt").to_pylist()
            yield pa.record_batch([*b.columns[:4], pa.array([bisect.bisect_right(borders, x) for x in zip(lo, salt, strict=True)], pa.int32())], schema=DEALT_URLS)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for h, p, v, lo in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict", "lo")), strict=True):
                first, last = bisect.bisect_left(los, lo), bisect.bisect_left(los, lo[:-1] + "/")
                rows += [(None, h, p, lo, k, v) for k in range(first, last + 1)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)

    dealt = urls.select("page_id", "host", "path", "lo", "salt").mapInArrow(deal_urls, "page_id long, host string, path string, lo string, part int").withColumn("verdict", F.lit(None).cast("string"))
    both = own.mapInArrow(deal_rules, "page_id long, host string, path string, lo string, part int, verdict string").unionByName(dealt)
    # rules come first within a range: their number there is that of the intervals that touch it
    swept = both.repartitionById(max(1, len(borders) + 1), F.col("part")).sortWithinPartitions("part", F.col("verdict").isNull(), "lo")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules_here, stack, part = [], None, None
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "host", "path", "lo", "part", "verdict")), strict=True)
            out: list[tuple] = []
            for page, h, p, lo, k, v in rows:
                if k != part:
                    rules_here, stack, part = [], None, k
                if v is not None:
                    rules_here.append((lo, h, p, v))
                    continue
                stack = stack or Stack(rules_here)
                rule, verdict = stack.best(lo, p) or (None, default)
                out.append((page, h, p, rule, verdict))
            if out:
                yield record(OUT, *(list(c) for c in zip(*out, strict=True)))

    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


DEALT_URLS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lo", pa.string()), ("part", pa.int32())])
DEALT = pa.schema([*DEALT_URLS, ("verdict", pa.string())])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), RULES_DDL)
    return url_filter(table(spark, sf_dir, "pages"), rules)


ORACLE = """
with p as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), q as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') as path from p
), r as (
  select *, '.' || host as h from q
), s as (
  select page_id, host, path,
    case when ends_with(h, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when ends_with(h, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when ends_with(h, '.org') and starts_with(path, '/fr/') then 'org/fr/'
         when ends_with(h, '.net') and starts_with(path, '/') then 'net/' end as rule from r
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from s
"""
