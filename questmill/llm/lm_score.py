"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt to blocks. A block explodes its documents into n-grams of
every order and asks for each distinct one, with how often it stands there, by the
shard that its hash names. A shard holds the n-gram count table for its hashes: it
adds up what all blocks sent, joins the sums to what each asked, and returns them.
The block joins the counts to its n-grams and sums the scores per document.

Were every block to send to every shard, there would be as many messages as the
square of the corpus. So blocks form groups, and the hashes of a group's blocks
are first put together by range: with the square root of the blocks, times a
factor, in a group, a message holds many n-grams at any size, and the n-grams that
a group's blocks share go on once. N-grams travel as sorted arrays of 64-bit hashes, and once per
block however often they occur, so a frequent n-gram is no hot key. Two n-grams
with one hash would share their counts; of 10^9 n-grams some 0.03 pairs do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block, about, and the share left to a shorter n-gram.
BLOCK_CHARS, BACKOFF = 16 << 20, 0.4
#: Blocks of a group, in parts of the square root of all: the larger a group, the more n-grams its blocks share.
GROUP = 4
#: N-grams of two words and more count from this many occurrences on: what occurs once is known from the scored text alone.
LEAST_COUNT = 2

_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) | 1
        return h


_hash = _WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found))


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 on, the hash of the n-gram that ends at each word; 0 where the text is too short before it."""
    out, now = [words], words
    for k in range(2, order + 1):
        longer = np.zeros_like(words)
        if len(words) >= k:
            # The words before, as the shorter n-gram that ends one word earlier, and this word.
            h = now[k - 2 : -1] * _P + words[k - 1 :] * np.uint64(2 * k + 1)
            longer[k - 1 :] = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        out.append(longer)
        now = longer
    return out


def _asked(texts: list[str | None], order: int) -> tuple[list[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """The n-grams of every text, and per order the distinct ones of all with their counts."""
    each = [grams(word_hashes(t), order) for t in texts]
    distinct = []
    for k in range(order):
        flat = np.concatenate([np.empty(0, np.uint64), *[g[k] for g in each]])
        distinct.append(np.unique(flat[flat != 0], return_counts=True))
    return each, distinct


def _edges(parts: int, of: int = 0, whole: int = 1) -> np.ndarray:
    """The first hash of each of the parts of range number of, when all hashes are cut into whole ranges."""
    return np.array([((of * parts + k) << 64) // (whole * parts) for k in range(parts)], np.uint64)


def _cut(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where each part's hashes begin in the sorted hashes, and their end."""
    return np.append(np.searchsorted(hashes, edges), len(hashes))


#: A message: who answers, who sends, the order, n-grams with counts. An answer: to whom, from whom, the order, counts.
ASK = "to_a long, to_b long, sender long, k int, hashes binary, counts binary"
ANSWER = "to_a long, to_b long, sender long, k int, totals binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs, behind a byte that tells how many."""
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpack(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    wide = int(raw[0])
    out = np.zeros(((len(raw) - 1) // wide, 8), np.uint8)
    out[:, :wide] = raw[1:].reshape(-1, wide)
    return out.view("<u8").ravel()


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the steps from each to the next."""
    return hashes[:1].astype("<u8").tobytes() + _pack(np.diff(hashes))


def _unpack_sorted(data: memoryview) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), _unpack(data[8:])]), dtype=np.uint64)


def _message(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _asks(asked: pa.Table, k: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of one order: the senders in order, what each asked, and all distinct n-grams with their counts and each one's place among them."""
    rows = [i for i, o in enumerate(asked.column("k").to_pylist()) if o == k]
    rows.sort(key=lambda i: asked.column("sender")[i].as_py())
    each = [_unpack_sorted(memoryview(asked.column("hashes")[i].as_buffer())) for i in rows]
    given = np.concatenate([np.empty(0, np.uint64), *[_unpack(asked.column("counts")[i].as_buffer()) for i in rows]])
    distinct, at = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_inverse=True)
    return [asked.column("sender")[i].as_py() for i in rows], each, distinct, np.bincount(at, given, len(distinct)), at


def _answers(replies: pa.Table, k: int) -> np.ndarray:
    """The totals of one order, in the order of those who answered."""
    rows = [i for i, o in enumerate(replies.column("k").to_pylist()) if o == k]
    rows.sort(key=lambda i: replies.column("sender")[i].as_py())
    own = [_unpack(replies.column("totals")[i].as_buffer()).astype(np.float64) for i in rows]
    return np.concatenate([np.empty(0), *own])


def backoff_scores(
    docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, least: int = LEAST_COUNT
) -> DataFrame:
    """One row per row of docs: id, n_tokens, log10_score (summed over the tokens).

    A token scores count(n-gram) / count(n-gram without it) for the longest n-gram
    of at most order words that ends there and occurs least times, times BACKOFF
    for every longer one passed over; a single word scores its share of all words.
    A text without words, or a null, has 0 tokens and score 0. Null ids and
    repeated rows are scored like others; other columns are ignored. An empty
    table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    chars, every = rows.agg(F.sum(F.length("text")), F.sum(words)).first()
    n, every = max(1, (chars or 0) // block_chars), every or 1
    # Blocks of a group, ranges of hashes, and shards of a range.
    ranges = min(n, GROUP * (math.isqrt(n - 1) + 1))
    shards = -(-n // ranges)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    def ask(part: pa.Table) -> pa.Table:
        block, (_, distinct) = part.column("block")[0].as_py(), _asked(part.column("text").to_pylist(), order)
        out = []
        for k, (hashes, counts) in enumerate(distinct):
            at = _cut(hashes, _edges(ranges))
            for r, mine in enumerate(map(slice, at[:-1], at[1:])):
                if mine.start < mine.stop:
                    out.append((block // ranges, r, block, k, _pack_sorted(hashes[mine]), _pack(counts[mine])))
        return _message(out, ASK)

    def together(asked: pa.Table) -> pa.Table:
        group, r = asked.column("to_a")[0].as_py(), asked.column("to_b")[0].as_py()
        out = []
        for k in range(order):
            _, _, hashes, counts, _ = _asks(asked, k)
            at = _cut(hashes, _edges(shards, r, ranges))
            for f, mine in enumerate(map(slice, at[:-1], at[1:])):
                if mine.start < mine.stop:
                    out.append((r, f, group, k, _pack_sorted(hashes[mine]), _pack(counts[mine])))
        return _message(out, ASK)

    def answer(asked: pa.Table) -> pa.Table:
        r, f = asked.column("to_a")[0].as_py(), asked.column("to_b")[0].as_py()
        out = []
        for k in range(order):
            groups, each, _, counts, at = _asks(asked, k)
            for group, own in zip(groups, np.split(counts[at], np.cumsum([len(e) for e in each])[:-1]), strict=True) if groups else ():
                out.append((group, r, f, k, _pack(own)))
        return _message(out, ANSWER)

    def apart(asked: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for k in range(order):
            blocks, each, _, _, at = _asks(asked, k)
            totals = _answers(replies, k)
            for block, own in zip(blocks, np.split(totals[at], np.cumsum([len(e) for e in each])[:-1]), strict=True) if blocks else ():
                out.append((block, 0, asked.column("to_b")[0].as_py(), k, _pack(own)))
        return _message(out, ANSWER)

    def add_up(part: pa.Table, replies: pa.Table) -> pa.Table:
        each, distinct = _asked(part.column("text").to_pylist(), order)
        totals = [_answers(replies, k) for k in range(order)]
        scores, sizes = [], []
        for g in each:
            size = len(g[0])
            count = [_count(totals[k], distinct[k][0], g[k]) for k in range(order)]
            value, open_, factor = np.zeros(size), np.ones(size, bool), np.ones(size)
            for k in range(order - 1, -1, -1):
                there = np.arange(size) >= k
                if k:
                    known = open_ & there & (count[k] >= least)
                    shorter = np.concatenate([[1.0], count[k - 1][:-1]]) if size else count[k - 1]
                    value[known] = np.log10(factor[known] * count[k][known] / shorter[known])
                    open_ &= ~known
                    factor[open_ & there] *= BACKOFF
                else:
                    value[open_] = np.log10(factor[open_] * count[0][open_] / every)
            scores.append(float(value.sum())), sizes.append(size)
        return pa.table({"doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "log10_score": pa.array(scores, pa.float64())})

    asked = dealt.groupBy("block").applyInArrow(ask, ASK)
    merged = asked.groupBy("to_a", "to_b").applyInArrow(together, ASK)
    answers = merged.groupBy("to_a", "to_b").applyInArrow(answer, ANSWER)
    answers = asked.groupBy("to_a", "to_b").cogroup(answers.groupBy("to_a", "to_b")).applyInArrow(apart, ANSWER)
    out = dealt.groupBy("block").cogroup(answers.withColumnRenamed("to_a", "block").groupBy("block")).applyInArrow(add_up, "doc_id long, n_tokens long, log10_score double")
    return out.withColumnRenamed("doc_id", id_col)


def _count(totals: np.ndarray, known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Totals of n-grams among the known ones; 0 for the hash 0, which is no n-gram."""
    out = np.zeros(len(hashes))
    there = hashes != 0
    if len(known):
        out[there] = totals[np.searchsorted(known, hashes[there])]
    return out
