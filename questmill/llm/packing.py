"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (one count for each length up to the
capacity) is solved centrally. A configuration is a multiset of lengths that fits
a sequence. The covering program (use configurations so that every length is
covered as often as it occurs, in as few sequences as possible) is solved in whole
numbers by multiplicative weights: each length has a price that falls as it gets
covered, and a knapsack dynamic program finds the configuration worth most at
these prices, until every length is covered. What remains at several points is
also packed best-fit decreasing, and the plan with the fewest sequences is taken.
Then every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.llm.common import in_slices, written
from questmill.llm.tokens import encoder

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def knapsack(prices: np.ndarray, capacity: int, most: np.ndarray | None = None) -> list[int]:
    """The lengths, with repeats, of the configuration worth most; prices[l] is the price of length l (-inf: none).

    Of equal ones the longest last piece is taken. With most, no more than most[l]
    pieces of length l are returned; a repeat beyond it is avoided where the table sees it.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    last, run = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    down, limit = prices[capacity:0:-1], np.full(capacity + 1, capacity) if most is None else most
    for c in range(1, capacity + 1):
        worth = down[capacity - c :] + best[:c]  # at i: a piece of length c - i after the best of i
        same = last[:c] == np.arange(c, 0, -1)
        worth[same & (run[:c] >= limit[last[:c]])] = -np.inf
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], take[c], last[c] = worth[i], c - i, c - i
            run[c] = run[i] + 1 if same[i] else 1
        else:
            best[c], last[c], run[c] = best[c - 1], last[c - 1], run[c - 1]
    lengths, c = [], capacity
    while c > 0:
        if take[c] and lengths.count(take[c]) < limit[take[c]]:
            lengths.append(int(take[c]))
        c -= int(take[c]) or 1
    return lengths


def plan(need: np.ndarray, capacity: int = CAPACITY, rounds: int = 150, rate: float = 8.0) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole numbers of sequences that hold exactly need[l] pieces of each length l.

    A configuration found is used for one part in rounds of the sequences, at least
    once, or as often as its scarcest length lasts. So the work depends on the
    capacity and the rounds, not on the number of pieces. At five points what is
    left is packed best-fit decreasing, and the point with the fewest sequences
    ends the program. Should best-fit decreasing alone take fewer, that is the plan.
    """
    need, done = need.astype(np.int64).copy(), []
    if need[capacity]:
        done.append(((capacity,), int(need[capacity])))
        need[capacity] = 0
    left, used, lengths = need.copy(), [], np.arange(capacity + 1)
    least = -(-int(need @ lengths) // capacity)
    best, size = [], np.inf
    share, before = max(1, least // rounds), 0
    marks = [0.5, 0.25, 0.1, 0.02, 0.0]
    while marks and size > least and left.any():
        there = left > 0
        lag = np.where(there, 1 - left / np.maximum(need, 1), 0)
        # A length that lags behind the others is dear, one ahead of them cheap.
        prices = np.where(there, lengths * np.exp(-rate * (lag - lag[there].min())), -np.inf)
        found = tuple(sorted(knapsack(prices, capacity, left), reverse=True))
        held = np.bincount(found, minlength=capacity + 1)
        n = min(share, int((left[held > 0] // held[held > 0]).min()))
        used.append((found, n))
        before += n
        left -= n * held
        if left @ lengths <= marks[0] * (need @ lengths):
            del marks[0]
            rest = _best_fit(left, capacity)
            if (total := before + sum(n for _, n in rest)) < size:
                best, size = used + rest, total
    alone = _best_fit(need, capacity)
    return done + (alone if sum(n for _, n in alone) < size else best)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, many equal pieces at a time: equal open sequences are one entry with a count."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1]:
        n, size = int(left[length]), int(length)
        for r in range(size, capacity):
            for found in list(room[r]):
                if not n:
                    break
                fits = r // size
                whole = min(room[r][found], n // fits)
                for times, used in ((fits, whole), (n - whole * fits if whole < room[r][found] and n - whole * fits < fits else 0, 1)):
                    if times and used:
                        key = found + (size,) * times
                        room[r - size * times][key] = room[r - size * times].get(key, 0) + used
                        n -= times * used
                        room[r][found] -= used
                if not room[r][found]:
                    del room[r][found]
            if not n:
                break
        fits = capacity // size
        for times, used in ((fits, n // fits), (n % fits, 1)):
            if times and used:
                key = (size,) * times
                room[capacity - size * times][key] = room[capacity - size * times].get(key, 0) + used
    return [(found, n) for by in room for found, n in by.items()]


@dataclass(frozen=True)
class Slots:
    """For each length: from which rank on which configuration takes its pieces, and where."""

    by_length: dict[int, tuple[np.ndarray, ...]]

    @classmethod
    def of(cls, configurations: list[tuple[tuple[int, ...], int]]) -> Slots:
        rows: dict[int, list[tuple[int, ...]]] = {}
        sequence, rank = 0, {}
        for found, n in configurations:
            offset = 0
            for length in sorted(set(found), reverse=True):
                times = found.count(length)
                rows.setdefault(length, []).append((rank.get(length, 0), times, sequence, offset))
                rank[length] = rank.get(length, 0) + n * times
                offset += times * length
            sequence += n
        return cls({length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()})

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of one length with these ranks."""
        first, times, sequence, offset = self.by_length[length]
        at = np.searchsorted(first, ranks, side="right") - 1
        k = ranks - first[at]
        return sequence[at] + k // times[at], offset[at] + k % times[at] * length


def pieces_of(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 (little-endian unsigned 32-bit ids).

    A document's ids are followed by the id end; a null text is an empty one. Only
    longer documents are cut, so that all pieces but the first are full.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, sizes = encoder(tokenizer).encode(batch.column(1).to_pylist())
            edges, out = np.concatenate([[0], np.cumsum(sizes)]), []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[edges[i] : edges[i + 1]], np.uint32(end)).astype("<u4")
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(own[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, PIECE_SCHEMA)


def ranked(pieces: DataFrame, length: Column, order: list[str], bucket_rows: int = 20_000) -> DataFrame:
    """pieces with rank: from 0 among those of the same length, in no set order between buckets.

    A length that very many pieces share is counted in buckets of the order
    columns' hash, so no task has to hold all of it.
    """
    n = pieces.count()
    buckets = max(1, n // bucket_rows)
    cut = pieces.withColumn("_length", length).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = cut.groupBy("_length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_length", "_bucket").orderBy(*order)) - 1
    return cut.withColumn("_within", within).join(bases, ["_length", "_bucket"]).withColumn("rank", F.col("_base") + F.col("_within")).drop("_length", "_bucket", "_base", "_within")


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; no sequence holds more than capacity tokens.

    Equal pieces may change places; repeated rows are pieces of their own. An
    empty table gives an empty one.
    """
    pieces = written(pieces, "pieces")
    need = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row for each length up to the capacity
        need[length] = n
    slots = Slots.of(plan(need, capacity))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                sequence[part], offset[part] = slots.place(int(length[part[0]]), rank[part])
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    placed = ranked(pieces, F.col("length"), ["doc_id", "piece"])
    return placed.mapInArrow(rows, f"{fields}, sequence_id long, offset long")
