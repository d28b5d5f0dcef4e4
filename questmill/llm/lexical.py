"""Ranked lexical search with block-max pruning.

build_index() writes the documents, in the order in which their files hold them, as
a forward index. A row holds a bounded number of neighbouring documents: their
distinct terms once, and for every document the places of its terms among these
with their occurrences. No document is shuffled for it.

search() first cuts the index down to the terms that are asked for and turns
occurrences into impacts. Each range of LEAF neighbouring documents is a block, and
the cut index also holds every block's largest impact of each term. A block's bound
for an item is the sum of the item's weights times these maxima. Two passes over
the blocks follow, both without a shuffle. The first scores, for every item, the
few blocks with the highest bounds of each stretch of blocks; the k-th score over
all these is a threshold that holds for the whole corpus. The second goes through
each stretch's blocks by descending bound, scores them, raises the threshold as it
goes, and stops at the first block whose bound is below it. Equal scores go by
doc_id, so a block whose bound equals the threshold is still scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questmill.llm.common import FEW_ROWS, in_slices, terms_of, written, written_with

#: A row of the index ends at so many documents or bytes of text; a block is so many documents.
ROW_DOCS, ROW_BYTES, LEAF = 64, 1 << 18, 4
#: Bounds that a task holds at a time, and the blocks of each stretch that an item's first pass scores.
MOST_BOUNDS, FIRST = 4_000_000, 8
#: How the index is written. A scan decodes up to 4,096 rows of a row group at once, which is all of it as rows are that wide, so groups are
#: small; and the writer looks at their size every few rows, where it waits for 100 otherwise.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}

INDEX = "docs int, total long, doc_ids array<long>, sizes array<int>, terms array<string>, dfs array<int>, counts array<int>, refs array<int>, tfs array<int>"
CUT = "doc_ids array<long>, counts array<int>, terms array<int>, impacts array<int>, widths array<int>, bound_terms array<int>, maxima array<int>"


def _lists(values: np.ndarray | list | pa.Array, kind: pa.DataType | None = None) -> pa.Array:
    """One row that holds all values as a list."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _row(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The row of the forward index for these documents."""
    flat, sizes = terms_of(batch.column(1))
    coded = flat.dictionary_encode()
    n, width = batch.num_rows, max(1, len(coded.dictionary))
    key, tf = np.unique(np.repeat(np.arange(n), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, ref = key // width, key % width
    row = {
        "docs": pa.array([int((sizes > 0).sum())], pa.int32()), "total": pa.array([int(sizes.sum())], pa.int64()),
        "doc_ids": _lists(batch.column(0)), "sizes": _lists(sizes.astype(np.int32)),
        "terms": _lists(coded.dictionary.cast(pa.string())), "dfs": _lists(np.bincount(ref, minlength=len(coded.dictionary)).astype(np.int32)),
        "counts": _lists(np.bincount(doc, minlength=n).astype(np.int32)), "refs": _lists(ref.astype(np.int32)), "tfs": _lists(tf.astype(np.int32)),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, ROW_DOCS):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // ROW_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield _row(batch.slice(a, b - a))


class Index:
    """A forward index: its blocks, the number of documents with terms, and the number of all terms."""

    def __init__(self, blocks: DataFrame, documents: int, terms: int):
        self.blocks, self.documents, self.terms = blocks, documents, terms


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The forward index of all rows. A null text has no terms; a row is a document, also where rows repeat an id or it is null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, total = written_with(rows.mapInArrow(_rows, INDEX), "lexical", {"n": F.sum("docs"), "l": F.sum("total")}, GROUPS)
    return Index(blocks, total["n"] or 0, total["l"] or 0)


class _Items:
    """The items of one batch: their terms, numbered, with weights, by item and by term."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.number: dict[str, int] = {}
        items: dict[int | None, int] = {}
        pairs = sorted((items.setdefault(i, len(items)), self.number.setdefault(t, len(self.number))) for i, t in rows)
        self.items, self.place = list(items), items
        self.of, self.term = np.array(pairs, np.int64).T
        self.edges = np.searchsorted(self.of, np.arange(len(self.items) + 1))
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.term_edges = self.of[order], np.searchsorted(self.term[order], np.arange(len(self.number) + 1))
        self.weights = np.zeros(len(self.number), np.int64)

    def bounds(self, blocks: np.ndarray, terms: np.ndarray, maxima: np.ndarray, n: int) -> np.ndarray:
        """n blocks x items: sums of weight times maximum, given as entries of block, term and maximum. Doubles hold these whole numbers exactly."""
        out = np.zeros(n * len(self.items))
        step = max(1, MOST_BOUNDS // max(1, len(self.items)))
        for a in range(0, len(terms), step):  # a term has at most one entry an item
            b, t, m = blocks[a : a + step], terms[a : a + step], maxima[a : a + step]
            width = self.term_edges[t + 1] - self.term_edges[t]
            at = np.repeat(self.term_edges[t] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            np.add.at(out, np.repeat(b * len(self.items), width) + self.by_term[at], np.repeat((self.weights[t] * m).astype(np.float64), width))
        return out.reshape(n, -1)


def _cut_down(batches: Iterator[pa.RecordBatch], items: _Items, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows with the asked terms alone, impacts instead of occurrences, and each block's largest impact of each term."""
    asked = pa.array(list(items.number), pa.string())
    for batch in in_slices(batches, 1):
        known = pc.fill_null(pc.index_in(batch.column("terms").flatten(), asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        refs, tfs, counts, sizes = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("refs", "tfs", "counts", "sizes"))
        term, doc = known[refs], np.repeat(np.arange(len(counts)), counts)
        doc, tf, term = doc[term >= 0], tfs[term >= 0], term[term >= 0]
        if not len(doc):
            continue
        m = 100 - 90 + (90 * sizes * documents) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        some, doc = np.unique(doc, return_inverse=True)  # documents without an asked term go
        key = doc // LEAF * len(asked) + term
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        top, key = np.maximum.reduceat(impact[order], first), key[order][first]
        ids = batch.column("doc_ids").flatten().take(pa.array(some))
        out = (np.bincount(doc), term, impact, np.bincount(key // len(asked)), key % len(asked), top)
        yield pa.RecordBatch.from_arrays(
            [_lists(ids), *[_lists(x.astype(np.int32)) for x in out]], names=["doc_ids", "counts", "terms", "impacts", "widths", "bound_terms", "maxima"]
        )


FOUND = "item long, doc_id long, score long"


class _Stretch:
    """The blocks of some rows of the cut index, one after another."""

    def __init__(self, rows: list[pa.RecordBatch]):
        def flat(c: str) -> np.ndarray:
            return np.concatenate([r.column(c).flatten().to_numpy().astype(np.int64) for r in rows])

        self.ids = pa.concat_arrays([r.column("doc_ids").flatten() for r in rows])
        self.terms, self.impacts, self.ends = flat("terms"), flat("impacts"), np.concatenate([[0], np.cumsum(flat("counts"))])
        self.widths, self.bound_terms, self.maxima = flat("widths"), flat("bound_terms"), flat("maxima")
        # A row's last block may hold fewer documents.
        docs = [np.diff([*range(0, n, LEAF), n]) for n in (len(r.column("counts")[0]) for r in rows)]
        self.docs = np.concatenate([[0], np.cumsum(np.concatenate(docs))])

    def bounds(self, items: _Items) -> np.ndarray:
        return items.bounds(np.repeat(np.arange(len(self.widths)), self.widths), self.bound_terms, self.maxima, len(self.widths))

    def scores(self, block: int, weight: np.ndarray) -> np.ndarray:
        """The scores of a block's documents under the weights of all terms."""
        ends = self.ends[self.docs[block] : self.docs[block + 1] + 1]
        mine = slice(ends[0], ends[-1])
        return np.add.reduceat(weight[self.terms[mine]] * self.impacts[mine], ends[:-1] - ends[0])


def _stretches(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[_Stretch]:
    held: list[pa.RecordBatch] = []
    for batch in in_slices(batches, 1):
        held.append(batch)
        if len(held) * ROW_DOCS // LEAF * items >= MOST_BOUNDS or len(held) == 256:
            yield _Stretch(held)
            held = []
    if held:
        yield _Stretch(held)


class _Best:
    """The best documents of one item so far, at most k: scores with ids, highest first, equal ones by id, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, max(floor, 1), []

    def add(self, scores: np.ndarray, ids: pa.Array, start: int) -> None:
        """Enter documents, whose ids stand from start on."""
        if scores.max() < self.floor:
            return
        for at in np.flatnonzero(scores >= self.floor).tolist():
            i = ids[start + at].as_py()
            self.rows.append((-int(scores[at]), i is None, i or 0, i))
        self.rows = sorted(self.rows, key=lambda r: r[:3])[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -self.rows[-1][0])


def _search(batches: Iterator[pa.RecordBatch], items: _Items, k: int, floors: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """Each item's best documents of a task's blocks. first: only of the FIRST blocks with the highest bounds of each stretch."""
    best, weight = [_Best(k, int(f)) for f in floors], np.zeros(len(items.weights), np.int64)
    for blocks in _stretches(batches, len(items.items)):
        bounds = blocks.bounds(items)
        for item in np.flatnonzero(bounds.max(axis=0) >= floors).tolist():
            own, mine, found = items.term[items.edges[item] : items.edges[item + 1]], bounds[:, item], best[item]
            weight[own] = items.weights[own]
            order = np.flatnonzero(mine >= found.floor)
            order = order[np.argsort(-mine[order], kind="stable")]
            for b in order[: FIRST if first else None].tolist():
                if mine[b] < found.floor:
                    break
                found.add(blocks.scores(b, weight), blocks.ids, blocks.docs[b])
            weight[own] = 0
    rows = [(items.items[n], i, -s) for n, b in enumerate(best) for s, _, _, i in b.rows]
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer(index: Index, asked: list[tuple[int | None, str]], k: int) -> DataFrame:
    """item, rank, doc_id and score of one batch of items, given as pairs of item and term."""
    spark = index.blocks.sparkSession
    items = _Items(asked)
    number = spark.sparkContext.broadcast(items)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(list(number.value.number), pa.string())
        df = np.zeros(len(asked), np.int64)
        for batch in in_slices(batches, 64):
            at = pc.index_in(batch.column("terms").flatten(), asked)
            there = at.is_valid()
            np.add.at(df, at.filter(there).to_numpy(), batch.column("dfs").flatten().filter(there).to_numpy())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    n, total = index.documents, index.terms
    # Written, as that bounds the Arrow batches. One row for each term of the batch.
    dfs = written(index.blocks.select("terms", "dfs").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "lexical-dfs")
    for row in dfs.collect():
        items.weights[row.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * row.df + 1)))
    given = spark.sparkContext.broadcast(items)
    cut = written(index.blocks.mapInArrow(lambda b: _cut_down(b, given.value, n, total), CUT), "lexical-cut", GROUPS)
    none = np.ones(len(items.items), np.int64)
    first = _ranked(cut.mapInArrow(lambda b: _search(b, given.value, k, none, True), FOUND), k)
    floors = none.copy()
    for row in written(first.where(F.col("rank") == k).select("item", "score"), "lexical-first").collect():  # at most one row an item of the batch
        floors[items.place[row["item"]]] = row.score
    return written(_ranked(cut.mapInArrow(lambda b: _search(b, given.value, k, floors, False), FOUND), k), "lexical-found")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", batch_terms: int = FEW_ROWS) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item_id, rank, doc_id, score.

    Rows that share an item's id, or have none, are one item with the terms of all
    their texts. An item without known terms has no rows, nor has an empty index.
    Items are answered in batches of about batch_terms pairs of item and term, so
    what tasks are sent has a bound whatever the number of items.
    """
    spark = items.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            terms, sizes = terms_of(batch.column(1))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, terms.cast(pa.string())], names=["id", "term"])

    pairs = items.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(split, "id long, term string").distinct()
    pairs, total = written_with(pairs, "lexical-items", {"n": F.count("*")})
    batches = -(-total["n"] // batch_terms) if index.terms else 0
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    for b in range(batches):
        asked = [(r.id, r.term) for r in pairs.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b).collect()]
        if asked:
            out = out.union(_answer(index, asked, k).select("item", "rank", "doc_id", "score"))
    return out.withColumnRenamed("item", id_col)
