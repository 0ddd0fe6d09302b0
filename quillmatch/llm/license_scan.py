"""Licence scans: fuzzy search for short notices.

Every notice may have up to k edits. By the pigeonhole principle one of its
k+1 pieces stands unchanged wherever the notice occurs, so an automaton over
all pieces finds every candidate place; the ``regex`` library's bounded-error
matching then verifies the edits in a window around the piece and reports the
span, which begins and ends with whole words. The scan is map-only: no shuffle, one block of texts in memory.

Defined results: a null text counts as empty; an empty text has no words and
score 0; repeated rows give repeated results; null ids pass through; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, pick, raw, record, table

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices searched with edits: (words, label). One edit is allowed per EDIT_EVERY characters.
NOTICES = (
    ("all rights reserved", "reserved"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution", "cc-by"),
    ("attribution sharealike", "cc-by-sa"),
    ("attribution noncommercial", "cc-by-nc"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("released into the public domain", "public-domain"),
    ("no rights reserved", "cc0"),
    ("the software is provided as is without warranty of any kind", "no-warranty"),
    ("this work is licensed under", "licensed"),
)
EDIT_EVERY = 10

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("found", pa.string())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int,found:string>>"


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length with their offsets."""
    cut = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, str], ...], every: int):
    import ahocorasick
    import regex

    found: dict[str, list[tuple[int, int]]] = {}
    exact = []
    for n, (notice, _) in enumerate(notices):
        k = max(1, len(notice) // every)
        exact.append((regex.compile(f"(?b)(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )"), k))
        for at, piece in pieces(notice, k):
            found.setdefault(piece, []).append((n, at))
    auto = ahocorasick.Automaton()
    for piece, where in found.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto, exact


def fuzzy_spans(joined: str, notices: tuple[tuple[str, str], ...] = NOTICES, every: int = EDIT_EVERY) -> list[tuple[int, int, int, int]]:
    """(notice index, start, end, edits) of verified matches of whole words; joined has a space before each word and at the end."""
    auto, exact = _scanner(tuple(notices), every)
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, where) in auto.iter(joined):
        for n, at in where:
            k = exact[n][1]
            lo = end + 1 - size - at - k
            hi = lo + len(notices[n][0]) + 2 * k + 1  # with the space behind
            windows.setdefault(n, []).append((lo, hi))
    out = []
    for n, own in windows.items():
        pattern = exact[n][0]
        joint: list[list[int]] = []
        for lo, hi in sorted(own):
            if joint and lo <= joint[-1][1]:
                joint[-1][1] = max(joint[-1][1], hi)
            else:
                joint.append([lo, hi])
        for lo, hi in joint:
            # the best match of a part need not be its first: both sides of it are searched again
            parts = [(max(0, lo), min(len(joined), hi))]
            while parts:
                a, b = parts.pop()
                if b - a >= len(notices[n][0]) - exact[n][1] and (m := pattern.search(joined, a, b)):
                    out.append((n, m.start(), m.end(), sum(m.fuzzy_counts)))
                    parts += [(a, m.start()), (m.end(), b)]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _phrase_starts(joined: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand; joined has a space at both ends."""
    key, out, at, word, last = f" {phrase} ", [], joined.find(f" {phrase} "), 0, 0
    while at >= 0:
        word += joined.count(" ", last, at)
        last = at
        out.append(word)
        at = joined.find(key, at + 1)
    return out


def scan_text(text: bytes, base=BASE, notices=NOTICES, every: int = EDIT_EVERY) -> tuple:
    words = text.lower().translate(_KEEP).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " " if words else ""
    starts, labels = [], set()
    for phrase, label in base:
        if own := _phrase_starts(joined, phrase):
            starts += own
            labels.add(label)
    spans, best = [], 1.0 if starts else 0.0
    found = fuzzy_spans(joined, notices, every)
    spaces = [i for i, c in enumerate(joined) if c == " "] if found else []
    for n, a, b, edits in found:
        spans.append({"label": notices[n][1], "first_word": bisect_right(spaces, a) - 1, "last_word": bisect_right(spaces, b - 1) - 1, "edits": edits, "found": joined[a:b]})
        best = max(best, 1.0 - edits / len(notices[n][0]))
    every_label = labels | {s["label"] for s in spans}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every_label)), best, spans


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES, every: int = EDIT_EVERY) -> DataFrame:
    """Words, exact phrases, fuzzily found notices with spans, and a score of every text.

    ``docs`` has doc_id and text. Spans give word numbers, the edits and the matched text.
    """
    base, notices = tuple(base), tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = [scan_text(t, base, notices, every) for t in raw(block.column(1))]
            yield record(OUT, block.column(0), *(list(c) for c in zip(*rows, strict=True)))

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
