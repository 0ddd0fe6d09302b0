"""Token ids of texts.

The byte-level BPE never merges across pre-tokens, and a space between two
characters that are not white space always begins a pre-token. So a long text
may be cut there, and the result equals encoding the text whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a text that are encoded at once, up to the next sure cut.
PART = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The pre-tokens of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file's place on this machine: a name of the public files, or a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes with the tokenizer file at ``path``; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(tokenizer_path(path), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
        # the same vocabulary, merges in the order of ids
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t != b"<|endoftext|>"}, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text, encoded in parts of bounded size."""
        if len(text) <= PART:
            return np.array(self.encode(text), dtype=np.int32)
        parts, at = [], 0
        while len(text) - at > PART:
            cut = _CUT.search(text, at + PART)
            if cut is None:
                break
            parts.append(np.array(self.encode(text[at : cut.start()]), dtype=np.int32))
            at = cut.start()
        return np.concatenate([*parts, np.array(self.encode(text[at:]), dtype=np.int32)])

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after another, number of ids of each); a null is the empty text."""
        own = [self.ids(t or "") for t in texts.to_pylist()]
        lens = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        return (np.concatenate(own) if own else np.zeros(0, dtype=np.int32)), lens

    def counts(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        return [len(self.encode(t)) if len(t) <= PART else len(self.ids(t)) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)
