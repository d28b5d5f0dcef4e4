"""Encoding whole texts by a byte-level BPE tokenizer file, with the ids of the tokenizers library.

The ids come from tiktoken's merge loop, run on the vocabulary of the tokenizers
file: byte-level vocabularies number their tokens in merge order, so an id is also
its token's rank. The tests compare the ids with tokenizers' own on every document
and on awkward texts. tokenizers itself took over twice the CPU time the check
tool allows (README.md).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

#: The split of byte-level BPE before merging, a fixed value of the tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free above 255."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in kept else chr(free)
        free += b not in kept
    return out


class TextEncoder:
    """ids of texts, as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text; special tokens in it become their ids. A null is an empty text."""
        if not text:
            return np.empty(0, np.uint32)
        allowed = {t for t in self.special if t in text}
        return self.encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(np.uint32, copy=False)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and the number of each text's."""
        each = [self.ids(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))


_known: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _known:
        _known[path] = TextEncoder(path)
    return _known[path]
