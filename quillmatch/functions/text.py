"""Normalising, tokenising and shingling as Column expressions.

Everything here stays in the JVM except the functions that need Unicode
normal forms, case folding or an HTML parser; those are Arrow-batched.
"""

from __future__ import annotations

import html.parser
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._udf import arrow

K = 9

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0x410, 0x430))) + "ЁІӘҒҚҢӨҰҮҺ" + "İıё"
_LOW = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x430, 0x450))) + "еіәғқңөұүһ" + "iiе"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row.

    A plain projection is merged into every later use, also into lambdas, which
    would repeat it for each element; a one-element explode is not.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def tokens(text: Column) -> Column:
    """Words of a text, none for the empty one: case folding for four alphabets, combining marks deleted, runs of word characters.

    The words are matched, not what stands between them: Java tests the
    characters of a negated class one by one through nested calls.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0300-\u036f]", "")
    return F.regexp_extract_all(F.translate(bare, _UP, _LOW), F.lit("[_0-9a-z\u0400-\u04ff]+"), F.lit(0))


def normalize(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.array_join(tokens(text), " ")


def shingle_list(words: str, k: int = K) -> Column:
    """All k-word windows, in order, of the array column named ``words``."""
    return F.expr(
        f"case when size({words}) >= {k} then transform(sequence(1, size({words}) - {k - 1}), i -> array_join(slice({words}, i, {k}), ' ')) else cast(array() as array<string>) end"
    )


def shingle_keys(words: str, k: int = K) -> Column:
    """64-bit keys of all k-word windows of the array column named ``words``."""
    return F.expr(
        f"case when size({words}) >= {k} then transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k}))) else cast(array() as array<bigint>) end"
    )


def each_window(df: DataFrame, k: int = K) -> DataFrame:
    """df (with ``words``) once for each k-word window, with its ``position`` from 0; ``window_words`` gives the window.

    Only positions are exploded, so the windows of a text never stand side by side, and no lambda makes them.
    """
    return df.where(F.size("words") >= k).select(*df.columns, F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("position"))


def window_words(k: int = K) -> Column:
    """The words of the window at ``position``."""
    return F.slice("words", F.col("position") + 1, F.lit(k))


def with_tokens(df: DataFrame, text: str = "text", name: str = "words") -> DataFrame:
    """df with its tokens in place of the text."""
    return once(df, name, tokens(F.col(text))).drop(text)


# --- other cleaners ------------------------------------------------------------

_INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff\u00ad]"


def norm_for_local(text: Column) -> Column:
    """Lower case; anything but a-z, the Russian and Kazakh letters, digits and spaces becomes one space."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-zа-яёіқғңөұүһ0-9ſı ]", " "), " +", " "))


def clean_spaces_punct(text: Column) -> Column:
    """Runs of anything but word characters and spaces become a space; spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def split_spaces(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _INVISIBLE, ""), "\u00a0", " ")


#: Letters and other word characters that are neither digits nor the underscore; a fixed class.
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_WORD = r"[\p{L}\p{N}_]"


def merge_hyphen_breaks(text: Column) -> Column:
    """Two runs of letters around a hyphen at a line end become one."""
    return F.regexp_replace(text, rf"(?U)({_LETTER}+)[-–—]\s*\n\s*({_LETTER}+)", "$1$2")


def collapse_line_breaks(text: Column) -> Column:
    """A single line break behind a character becomes a space."""
    return F.regexp_replace(text, r"(?<=[^\n])\n(?!\n)", " ")


def fix_small_splits(text: Column, passes: int = 3) -> Column:
    """Neighbours of one to three letters that a bad extraction has split are joined."""
    for _ in range(passes):
        text = F.regexp_replace(text, rf"(?U)(?<!{_WORD})({_LETTER}{{1,3}})\s({_LETTER}{{1,3}})(?!{_WORD})", "$1$2")
    return text


def norm_spaces(text: Column) -> Column:
    """Two or more blanks become one, two or more line breaks with the blanks around them an empty line; both ends are stripped."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r" *\n{2,} *", "\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def alpha_density(text: Column) -> Column:
    """Share of letters and digits; 0 for the empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / n).otherwise(F.lit(0.0))


def pdf_cleanup(text: Column) -> Column:
    """The clean-up chain for text extracted from pages."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return norm_spaces(fix_small_splits(collapse_line_breaks(merge_hyphen_breaks(strip_invisible(text)))))


@arrow("string")
def nfkc_lower(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Invisible characters stripped, compatibility normal form, lower case."""
    gone = re.compile(_INVISIBLE)
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", gone.sub("", t).replace("\u00a0", " ")).lower())


#: A letter, a hyphen, white space, a letter; a fixed pattern.
_BROKEN = re.compile(r"([^\W\d_])-\s+([^\W\d_])")


def _fold(t: str) -> str:
    """Composed letters keep their marks; only marks that stand alone after composing and folding go."""
    whole = _BROKEN.sub(r"\1\2", re.sub(_INVISIBLE, "", t).replace("\u00a0", " "))
    folded = unicodedata.normalize("NFKC", whole).casefold()
    bare = "".join(c for c in folded if unicodedata.category(c) != "Mn").replace("ё", "е")
    return re.sub("[^_0-9a-zA-Z\u00c0-\u02af\u0400-\u04ff]+", " ", bare).strip()


@arrow("string")
def normalize_wide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The wider normaliser: hyphenated breaks joined, composed, case folded, loose marks dropped, extended Latin kept."""
    for s in batches:
        yield s.map(lambda t: None if t is None else _fold(t))


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(page: str) -> str:
    """Text nodes joined by spaces, without scripts, styles and comments."""
    p = _Text()
    p.feed(page)
    p.close()
    return " ".join(p.parts)


@arrow("string")
def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else html_to_text(t))


@arrow("string")
def decode_lossy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 text of bytes; invalid bytes are dropped."""
    for s in batches:
        yield s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))
