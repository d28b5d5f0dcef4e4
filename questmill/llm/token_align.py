"""Alignment of two tokenizers' ids over the same bytes.

Tokens are byte intervals of space + text. Where a token of A and one of B end
together, both cut the text; what lies between two cuts is a group, and all ids of
A in it are linked with all of B.

No token of either vocabulary holds a space behind anything else, and A's split
before merging never joins a space to a word before it. So a text is cut before
every space that stands behind a character that is no white space, each such word
has its tokens by itself, and the end of a word is a cut. Documents are taken in
blocks of a task; the words that a worker does not know yet are encoded and become two tables
of token intervals in DuckDB, which finds cuts by joining ends, numbers A's groups
by a window sum, gives B's tokens their groups by an as-of join, links by joining
groups, and adds up the links per document.

Each block keeps its distinct pairs of ids with the number of its documents that
hold them. Spark adds these partial counts up per pair, takes the highest per id of
A, and returns each block the totals of its own pairs, so a pair travels once a
block however many documents hold it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questmill.llm.common import in_slices, written

#: Bytes of a block, about. A longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words a worker remembers between blocks.
MOST_WORDS = 300_000
#: Ids of B are below this; a pair is a * PAIR + b.
PAIR = 1 << 20

BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs array<long>, dfs array<int>, widths array<int>, refs binary, times binary"
)
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BOUNDARY = re.compile(r"(?<=\S) ")


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizers file."""
    from questmill.llm.tokens import byte_characters

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"] for t in spec["added_tokens"]}
    out = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for t, i in spec["model"]["vocab"].items():
        out[i] = b"" if t in special else bytes(map(byte_of.__getitem__, t))
    return out


class Pair:
    """Both tokenizers: byte-level BPE from a tokenizers file (A), pieces from a sentencepiece model (B)."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        import tiktoken

        from questmill.llm.tokens import PIECES

        of_a = byte_tokens(byte_bpe)
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks={t: i for i, t in enumerate(of_a) if t}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.of_b, self.space = of_b, names.index("▁")
        self.long_a, self.long_b = (np.array([len(t) for t in x], np.int64) for x in (of_a, of_b))
        self.words = Words(self)
        # Decimal ids behind which a list goes on, ends, or a group ends.
        tails = [(",", "|"), (",", ";")]
        self.said = [[np.array([f"{i}{t}" for i in range(len(x))], object) for t in pair] for x, pair in zip((of_a, of_b), tails, strict=True)]

    def encode_a(self, words: list[str]) -> np.ndarray:
        """The ids of all words, each behind a space, one after another. Only a word that ends in white space meets its neighbour's."""
        open_ended = [i for i, w in enumerate(words) if not w or w[-1].isspace()]
        parts, start = [], 0
        for i in [*open_ended, len(words)]:
            if start < i:
                parts.append(self.a.encode_to_numpy(" " + " ".join(words[start:i]), disallowed_special=()))
            if i < len(words):
                parts.append(self.a.encode_to_numpy(" " + words[i], disallowed_special=()))
            start = i + 1
        return np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)

    def encode_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each behind a space, one after another, and the number of each word's."""
        ids = [x or [self.space] for x in self.b.encode(words, num_threads=1)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


_known: dict[tuple[str, str], Pair] = {}


def tokenizers(byte_bpe: str, pieces: str) -> Pair:
    """This worker's pair of tokenizers."""
    if (byte_bpe, pieces) not in _known:
        _known[byte_bpe, pieces] = Pair(byte_bpe, pieces)
    return _known[byte_bpe, pieces]


#: Tables of DuckDB: a and b (id, e: where the token ends, from 1 on over all new words one after another), words (w, e), docs (d, w, n).
CUTS = "CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.e FROM a SEMI JOIN b ON a.e = b.e"
GROUPS_A = """CREATE OR REPLACE TEMP TABLE ga AS SELECT id, e, coalesce(sum(cut) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM (SELECT a.id, a.e, (cuts.e IS NOT NULL)::INT AS cut FROM a LEFT JOIN cuts ON a.e = cuts.e)"""
NUMBERED = "CREATE OR REPLACE TEMP TABLE spans AS SELECT e, row_number() OVER (ORDER BY e) - 1 AS g FROM cuts"
GROUPS_B = "CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, b.e, s.g FROM b ASOF JOIN spans s ON b.e <= s.e"
GROUP_WORDS = "CREATE OR REPLACE TEMP TABLE gw AS SELECT s.g, w.w FROM spans s ASOF JOIN words w ON s.e <= w.e"
# Within a group equal ids are counted before they are linked, so a long group of few ids stays small.
LINKS = f"""INSERT INTO links SELECT w, x.id * {PAIR} + y.id AS pair, sum(x.n * y.n)::BIGINT AS n
FROM (SELECT g, id, count(*) AS n FROM ga GROUP BY g, id) x JOIN (SELECT g, id, count(*) AS n FROM gb GROUP BY g, id) y ON x.g = y.g JOIN gw ON gw.g = x.g GROUP BY w, pair"""
PER_DOC = "SELECT d, pair, sum(docs.n * links.n)::BIGINT AS n FROM docs JOIN links ON docs.w = links.w GROUP BY d, pair ORDER BY d, pair"


class Words:
    """What a worker knows of words: their numbers, how many tokens of A, of B and groups each has, its groups as text, and its links in DuckDB."""

    def __init__(self, both: Pair):
        self.both, self.number, self.said, self.sizes = both, {}, [], np.empty((0, 3), np.int64)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("CREATE TABLE links (w BIGINT, pair BIGINT, n BIGINT)")

    def learn(self) -> None:
        """Align the words whose groups are not known yet."""
        start, both, con = len(self.said), self.both, self.con
        words = list(itertools.islice(self.number, start, None))
        if not words:
            return
        ids_a, (ids_b, _) = both.encode_a(words), both.encode_b(words)
        ends_a, ends_b = np.cumsum(both.long_a[ids_a]), np.cumsum(both.long_b[ids_b])
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        for name, table in (("a", {"id": ids_a, "e": ends_a}), ("b", {"id": ids_b, "e": ends_b}), ("words", {"w": np.arange(len(words)) + start, "e": ends})):
            con.register(name, pa.table(table))
        for step in (CUTS, GROUPS_A, NUMBERED, GROUPS_B, GROUP_WORDS, LINKS):
            con.execute(step)
        groups = [con.execute(f"SELECT g FROM {t} ORDER BY e").fetchnumpy()["g"] for t in ("ga", "gb")]
        word_of = con.execute("SELECT w FROM gw ORDER BY g").fetchnumpy()["w"] - start
        sizes = np.stack([np.bincount(word_of[g], minlength=len(words)) for g in groups] + [np.bincount(word_of, minlength=len(words))], 1).astype(np.int64)
        # A's tokens of a group stand before B's; the last one of each says how its list ends.
        said = []
        for (goes_on, ends_here), ids, g in zip(both.said, (ids_a, ids_b), groups, strict=True):
            last = np.append(np.diff(g) > 0, True)
            said.append(np.where(last, ends_here[ids], goes_on[ids]))
        order = np.lexsort((np.repeat([0, 1], [len(g) for g in groups]), np.concatenate(groups)))
        text, at = np.concatenate(said)[order].tolist(), np.concatenate([[0], np.cumsum(sizes[:, :2].sum(1))]).tolist()
        self.said += ["".join(text[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        self.sizes = np.concatenate([self.sizes, sizes])


def _bytes_of(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the lowest of all first, so that the zeros above lie together."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _block(block: int, ids: list, texts: list[str | None], both: Pair) -> pa.RecordBatch:
    if len(both.words.number) > MOST_WORDS:
        both.words = Words(both)
    known = both.words
    number, rows = known.number, []
    for text in texts:
        words = _BOUNDARY.split(f" {text}") if text and "▁" not in text else []
        if words:
            words[0] = words[0][1:]
        rows.append([number.setdefault(w, len(number)) for w in words])
    known.learn()
    d = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.fromiter(itertools.chain.from_iterable(rows), np.int64, len(d))
    width = max(1, len(number))
    key, n = np.unique(d * width + w, return_counts=True)
    known.con.register("docs", pa.table({"d": key // width, "w": key % width, "n": n}))
    held = known.con.execute(PER_DOC).fetchnumpy()
    sizes, said = known.sizes, known.said
    totals = np.zeros((len(rows), 3), np.int64)
    np.add.at(totals, d, sizes[w])
    pairs, refs, dfs = np.unique(held["pair"], return_inverse=True, return_counts=True)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, held["d"], held["n"])
    widths = np.bincount(held["d"], minlength=len(rows))
    # In a document pairs ascend: what is kept is each one's distance to the one before.
    steps = np.diff(refs, prepend=0)
    first = (np.cumsum(widths) - widths)[widths > 0]
    steps[first] = refs[first]
    shas = [hashlib.sha256("".join([said[k] for k in r])[:-1].encode()).hexdigest() if r else "" for r in rows]
    lists = [
        pa.array(ids, pa.int64()), *[pa.array(totals[:, k]) for k in range(3)], pa.array(links), pa.array(shas, pa.string()),
        pa.array(pairs, pa.int64()), pa.array(dfs.astype(np.int32)), pa.array(widths.astype(np.int32)),
    ]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    raw = [pa.array([_bytes_of(x)], pa.binary()) for x in (steps, held["n"])]
    names = ["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "dfs", "widths", "refs", "times"]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *columns, *raw], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], both: Pair) -> Iterator[pa.RecordBatch]:
    block, ids, texts, size = TaskContext.get().partitionId() << 40, [], [], 0
    for batch in in_slices(batches, 64):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i), texts.append(text)
            size += len(text or "")
            if size >= BLOCK_BYTES or len(ids) >= 50_000:
                yield _block(block, ids, texts, both)
                block, ids, texts, size = block + 1, [], [], 0
    if ids:
        yield _block(block, ids, texts, both)


def _finish(block: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of its pairs added up over their links."""
    (row,) = block.select(["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "widths", "refs", "times"]).to_pylist()
    order = np.argsort(totals.column("pair").to_numpy())
    count, best = totals.column("count").to_numpy()[order], totals.column("best").to_numpy()[order].astype(np.int64)
    widths, steps, times = np.array(row["widths"], np.int64), _numbers_of(row["refs"]), _numbers_of(row["times"])
    ends = np.cumsum(widths)
    run = np.concatenate([[0], np.cumsum(steps)])
    refs = run[1:] - np.repeat(run[ends - widths], widths)

    def added(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values[refs] * times)]) if len(refs) else np.zeros(1, np.int64)
        return pa.array(total[ends] - total[ends - widths], pa.int64())

    plain = {c: pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
    out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), **plain, "n_best": added(best), "count_sum": added(count)}
    return pa.table({**out, "groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def align(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Align both tokenizers over all texts.

    The first result has a row per document: doc_id, n_a, n_b, n_groups, n_links,
    n_best (links whose pair is held by as many documents as the best pair of its
    id of A, ties included), count_sum (the documents that hold the pair, over all
    links) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`). The second is the table of
    pairs: a, b, count (documents that hold the pair), best. A null or empty text,
    and one that holds U+2581, which B reads as a space, has no tokens: zeros and
    ''. Special tokens in texts are plain text. Null ids and repeated rows are
    documents like others; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInArrow(lambda b: _blocks(b, tokenizers(byte_bpe, pieces)), BLOCKS), "align-blocks")
    each = blocks.select("block", F.explode(F.arrays_zip("pairs", "dfs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.dfs").alias("df"))
    count = written(each.groupBy("pair").agg(F.sum("df").alias("count")), "align-counts")
    a = F.floor(F.col("pair") / PAIR)
    # One row for each id of A: no more than its vocabulary has.
    most = F.broadcast(count.groupBy(a.alias("a")).agg(F.max("count").alias("most")))
    count = count.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = each.join(count, "pair").select(F.col("block").alias("to"), "pair", "count", "best")
    out = blocks.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_finish, OUT)
    return out.withColumnRenamed("doc_id", id_col), count.select(a.alias("a"), F.pmod("pair", F.lit(PAIR)).alias("b"), "count", "best")
