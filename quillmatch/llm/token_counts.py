"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A document is cut into leaves of some dozens of words at places where a
pre-token always begins: a space before a non-space character. The tree holds
characters and tokens of each subtree. An edit is located by characters; only
the leaves that it touches are encoded anew, with the leaf before if the edit
leaves no sure cut at their start, and the sums on the paths above are updated.
The result equals encoding the whole edited text.

Defined results: a null text counts as empty (no tokens); edits beyond the text
are clipped to it; an empty replacement deletes; repeated rows and null ids are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, pick, record, table
from ._tokens import TOKENIZER, encoder

LEAF_WORDS = 48
#: Edits of the query: what a release would redact.
REDACT = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[email]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[address]"),
    (r"\b[0-9a-f]{32,}\b", "[key]"),
    (r"\b\d(?:[ -]?\d){8,}\b", "[number]"),
)
_CUT = re.compile(r" (?=\S)")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_leaves", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars_encoded_again", pa.int64())])
_DDL = "doc_id long, n_chars long, n_tokens long, n_leaves long, n_edits long, n_tokens_edited long, n_chars_encoded_again long"


def leaves(text: str, words: int = LEAF_WORDS) -> list[str]:
    """The text in parts; each but the first begins with a space and a non-space character."""
    if not text:
        return []
    parts, out = _CUT.split(text), []
    for k in range(0, len(parts), words):
        out.append((" " if k else "") + " ".join(parts[k : k + words]))
    return out


class DocumentTokens:
    """The tree of one document. ``count`` gives the numbers of tokens of a list of texts."""

    def __init__(self, parts: list[str], tokens: list[int], count: Callable[[list[str]], list[int]], words: int = LEAF_WORDS):
        self.count, self.words = count, words
        self.again = 0
        self._build(parts, tokens)

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.size = 1 << max(0, len(parts) - 1).bit_length()
        self.parts = parts + [""] * (self.size - len(parts))
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, n) in enumerate(zip(parts, tokens, strict=True)):
            self.chars[self.size + i], self.sums[self.size + i] = len(p), n
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf that holds character ``at``, its first character); the end belongs to the last."""
        node, begin = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            if at < begin + left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        return node - self.size, begin

    def _set(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        node = self.size + leaf
        self.chars[node], self.sums[node] = len(part), tokens
        while node := node // 2:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start..end by ``new``; returns the number of tokens of the text."""
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        (first, begin), (last, _) = self._leaf(start), self._leaf(max(start, end - 1))
        whole = "".join(self.parts[first : last + 1])
        part = whole[: start - begin] + new + whole[end - begin :]
        while first and not (len(part) > 1 and part[0] == " " and not part[1].isspace()):  # no sure cut: take what stands before
            first -= 1
            part = self.parts[first] + part
        self.again += len(part)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        self._set(first, part, self.count([part])[0])
        if len(part) > 64 * self.words * 8:  # a leaf that has grown large: build anew
            again = leaves(self.text(), self.words)
            self._build(again, self.count(again))
        return self.n_tokens


def find_edits(text: str, rules: list[tuple[re.Pattern, str]]) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) without overlaps, last first."""
    found = sorted((m.start(), -m.end(), new) for pattern, new in rules for m in pattern.finditer(text))
    out, upto = [], 0
    for a, b, new in found:
        if a >= upto:
            out.append((a, -b, new))
            upto = -b
    return out[::-1]


def token_counts(docs: DataFrame, rules=REDACT, words: int = LEAF_WORDS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokens of every document, before and after the edits that ``rules`` (pattern, replacement) make."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, patterns = encoder(tokenizer), [(re.compile(p, re.ASCII), new) for p, new in rules]
        for block in blocks(batches):
            texts = [t or "" for t in block.column(1).to_pylist()]
            parts = [leaves(t, words) for t in texts]
            counts = code.counts([p for own in parts for p in own])
            rows, at = [], 0
            for text, own in zip(texts, parts, strict=True):
                tokens = counts[at : at + len(own)]
                at += len(own)
                edits = find_edits(text, patterns)
                after, again = sum(tokens), 0
                if edits:
                    tree = DocumentTokens(own, tokens, code.counts, words)
                    for a, b, new in edits:
                        after = tree.edit(a, b, new)
                    again = tree.again
                rows.append((len(text), sum(tokens), len(own), len(edits), after, again))
            yield record(_OUT, block.column(0), *(list(c) for c in zip(*rows, strict=True)))

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
