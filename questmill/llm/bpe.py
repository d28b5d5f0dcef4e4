"""Byte-pair encoding and decoding with a pair occurrence index.

The words of a batch of documents are deduplicated. The distinct ones lie side by
side in one array of symbols with links to the previous and next symbol. An index
holds, for every pair of neighbouring symbols that the vocabulary can merge, all
its positions, by rank. Ranks that occur are applied in ascending order: every
position of the pair is merged at once, and the positions of the pairs that thereby
vanish or arise are updated in the index. A merge only makes pairs of higher rank,
so each rank is applied once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questmill.llm.common import in_slices
from questmill.llm.tokens import byte_characters

#: Words a worker remembers between batches.
MOST_WORDS = 300_000


class PairIndex:
    """Positions of all mergeable pairs of a batch of words, by rank."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], size: int):
        ranks = np.array([m[0] for m in merges.values()], np.int64)
        keys = np.array([a * size + b for a, b in merges], np.int64)
        made = np.array([m[1] for m in merges.values()], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], ranks[order]
        self.made = np.empty(int(ranks.max()) + 1 if len(ranks) else 0, np.int64)
        self.made[ranks] = made

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, and where each word ends. ends: where each word ends before."""
        n = len(symbols)
        if not n:
            return symbols, ends
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts = np.concatenate([[0], ends[:-1]])
        after[ends[ends > starts] - 1] = -1
        before[starts[ends > starts]] = -1
        alive = np.ones(n, bool)
        ranks = np.full(n, -1, np.int64)  # of the pair that starts at a position, as it is now
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that now start at these positions."""
            at = at[after[at] >= 0]
            rank = self.rank_of(symbols[at], symbols[after[at]])
            ranks[at] = rank
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[alive[at] & (ranks[at] == r)]
            if not len(at):
                continue
            right = after[at]
            if symbols[at[0]] == symbols[right[0]]:  # in a run of one symbol every other pair merges, from the left
                at = np.sort(at)
                right = after[at]
                chained = np.concatenate([[False], right[:-1] == at[1:]])
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(chained, 0, place))
                odd = (place - head) % 2 == 1
                at, right = at[~odd], right[~odd]
            symbols[at] = self.made[r]
            alive[right] = False
            ranks[right] = -1
            beyond = after[right]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            ranks[at] = -1
            left = before[at]
            left = left[left >= 0]
            note(np.unique(np.concatenate([left[alive[left]], at])))
        kept = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], kept[ends]


class WordBpe:
    """A BPE tokenizer file with word ends: lower case, pieces of letters, digits or marks, white space dropped."""

    #: How the file splits a text; fixed values of the tokenizer.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary, self.suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(self.vocabulary.values()) + 1
        made = {}
        for rank, (a, b) in enumerate(pairs):
            made.setdefault((self.vocabulary[a], self.vocabulary[b]), (rank, self.vocabulary[a + b]))
        self.index = PairIndex(made, size)
        chars = byte_characters()
        self.inner = np.array([self.vocabulary[c] for c in chars], np.int64)
        self.final = np.array([self.vocabulary[c + self.suffix] for c in chars], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.count = np.empty(0, np.int32), np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode words (runs without white space) that are not known yet."""
        pieces = [self.PIECES.findall(w) for w in new]
        known: dict[str, int] = {}
        rows = [[known.setdefault(p, len(known)) for p in row] for row in pieces]
        raw = [p.encode() for p in known]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        if len(ends):
            symbols[ends - 1] = self.final[data[ends - 1]]
        merged, cuts = self.index.merge(symbols, ends)
        starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
        at = np.fromiter((p for row in rows for p in row), np.int64)
        count = (cuts - starts)[at]
        ends = np.cumsum(count)
        ids = merged[np.repeat(starts[at] - (ends - count), count) + np.arange(count.sum())].astype(np.int32)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, np.diff(edge)])

    def _normal(self, text: str) -> str:
        # Lower-casing goes letter by letter: no final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _words(self, text: str) -> list[str]:
        # str.split() also splits at four separators that are no white space to the tokenizer.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in regex.split(r"\p{White_Space}+", text) if w]
        return text.split()

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's. A null is an empty text."""
        rows: list[list[str | int]] = []
        for text in texts:
            if text and any(t in text for t in self.added):
                parts = self.specials.split(text)
                rows.append([w for i, p in enumerate(parts) for w in ([self.added[p]] if i % 2 else self._words(self._normal(p)))])
            else:
                rows.append(self._words(self._normal(text)) if text else [])
        if len(self.words) > MOST_WORDS:
            self._clear()
        distinct = {w for row in rows for w in row}
        fixed = {w for w in distinct if isinstance(w, int)}
        self._learn([w for w in distinct if w not in self.words and w not in fixed])
        if fixed:  # added tokens are words of one id each
            for w in fixed:
                self.words[w] = len(self.words)  # type: ignore[index]
            self.ids = np.concatenate([self.ids, np.array(sorted(fixed), np.int32)])
            self.count = np.concatenate([self.count, np.ones(len(fixed), np.int64)])
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter((n for row in rows for n in map(self.words.__getitem__, row)), np.int64, int(sizes.sum()))
        count, first = self.count[at], np.cumsum(self.count) - self.count
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(first[at] - (ends - count), count) + np.arange(count.sum())]
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        if fixed:
            for w in fixed:
                del self.words[w]  # type: ignore[arg-type]
            self._clear()
        return ids, np.diff(edge)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: their tokens joined by a space, as the file names no decoder."""
        names = self.names.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), names), " ")


_known: dict[str, WordBpe] = {}


def bpe(path: str) -> WordBpe:
    """This worker's encoder for a tokenizer file."""
    if path not in _known:
        _known[path] = WordBpe(path)
    return _known[path]


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text, as the tokenizers library gives them without special tokens.

    A null text is an empty one, without ids. A null id, repeated rows and very
    long texts are encoded like any other; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, sizes = bpe(tokenizer).encode(batch.column(1).to_pylist())
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(rows, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, ids) with text: what decoding the ids gives, special tokens included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            text = bpe(tokenizer).decode(batch.column("ids")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, text string")
