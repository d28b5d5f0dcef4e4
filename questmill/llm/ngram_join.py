"""Near-duplicate texts by the Jaccard similarity of their word shingles: a size-aware heavy-light join.

Every document becomes the set of its distinct five-word shingles (64-bit hashes).
Equal sets are one class. Shingles are ordered by how often they occur, rare ones
first, by a fixed-size counting sketch, so that what many texts share comes last.

* Light sets (below a boundary) enumerate the two-element subsets of their rare
  end; two similar light sets share one.
* Heavy sets, and light ones near the boundary, enter the inverted lists of the
  shingles of their rare end; two similar sets, one of them heavy, share a list.

The boundary is where a set's subsets would cost more rows than scanning its lists,
whose expected length the sketch gives. Each entry also carries the largest overlap
still possible, which prunes pairs without looking at the sets.

Each list is one run of a sorted partition; one that may be long is dealt to parts.
A list with few members, or with few pairs across components, has those pairs
compared and is done. Of a longer one, every member is compared with a few
others of about its size; the links found give components, and the list goes
into the next round only where it still holds several. So a group of thousands of
similar texts does not become millions of pairs. Pairs within a component need no
comparison: they would change no component. All comparisons are exact, on the
sets; no list, pair or partner is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questmill.llm.common import components, in_slices, written, written_with

WORDS, PERCENT = 5, 75
#: Counters of the sketch, in slices; its size does not grow with the input.
SKETCH, SLICES = 1 << 20, 64
#: A list is dealt to parts of about so many entries.
HOT = 4096
#: Bits of the filter for the documents that have candidates at all.
FILTER_BITS = 1 << 24
#: What one more member of a list costs its scan, in rows dealt to lists.
COST_OF_PAIR = 0.02
#: Lists of so many members, or so many pairs a member that can be similar and lie in different components, have all those compared at once.
SHORT, CROSS = 8, 8
#: Members of a list that all others of about their size are compared with in a round, besides one at random.
HEADS = 2
#: Rounds of comparing members of the other lists with a few of their size, while each finds a link for so many members,
#: before all that lie apart are compared.
ROUNDS, LEAST_FOUND = 4, 100
#: Digests that a task remembers, to leave out repeats.
MOST_SEEN = 500_000

PAIR = ["a", "da", "b", "db"]
ENTRY = ["key", "part", "parts", "meta", "digest", "id"]
#: meta: the size of the set, shifted by 32 bits, and the largest overlap possible from here on.
ENTRY_SCHEMA = "key long, part int, parts int, meta long, digest long, id long"
ENTRY_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
MET_SCHEMA = f"a long, da long, b long, db long, {ENTRY_SCHEMA}"

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHash()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices. Behind the last, the task's words are forgotten, so that an idle worker holds none."""

    def whole() -> Iterator[pa.RecordBatch]:
        yield from batches
        _hash.clear()

    return in_slices(whole())


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text.

    Only A-Z are lower-cased, only ASCII white space separates words. A text of
    fewer words is one shingle, a text without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64) if found else np.empty(0, np.uint64)
    each = np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found))
    n = len(found) - words + 1
    h = each[:n].copy()
    for i in range(1, words):
        h = h * _P + each[i : i + n]
    return np.unique(_mix(h))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of every set, then this task's sketch in slices."""
    names, kinds = ["id", "n", "digest", "slice", "counts"], [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    sketch = np.zeros(SKETCH, np.int64)
    for batch in _slices(batches):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        sketch += np.bincount((every & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        none = [None] * len(sets)
        values = [batch.column(0), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], none, none]
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
    parts = [pa.compress(p.astype("<u4").tobytes(), "zstd", asbytes=True) for p in np.split(np.minimum(sketch, 0xFFFFFFFF), SLICES)]
    none = [None] * SLICES
    values = [none, none, none, range(SLICES), parts]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(counts, SKETCH // SLICES * 4, "zstd"), "<u4").astype(np.int64)
            total[s] = total[s] + part if s in total else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"]
    )


def boundary(sketch: np.ndarray, percent: int = PERCENT) -> int:
    """The size from which scanning lists is cheaper than enumerating subsets.

    The sketch's second moment, less what chance gives, is how many others a
    shingle meets on average.
    """
    total = max(1.0, float(sketch.sum()))
    meets = max(0.0, (float((sketch.astype(np.float64) ** 2).sum()) - total**2 / len(sketch)) / total - 1)
    size = 2
    while size < 1 << 12:
        rare = size - -(-percent * size // 100) + 1
        if (rare + 1) * rare / 2 > rare * (1 + COST_OF_PAIR * meets):
            break
        size += 1
    return size


def _entries(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, light: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The list entries of every distinct set: key, part and parts of its list, size and largest overlap possible, digest, id."""
    noise = float(np.median(sketch))
    beyond = noise + 4 * noise**0.5
    seen: dict[int, int] = {}
    for batch in _slices(batches):
        keys, most, oftens, docs = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = shingles(text)
            n = len(h)
            if n < 2:  # similar to equal sets only
                continue
            digest = xxhash.xxh3_64_intdigest(h.tobytes())
            if seen.get(digest, doc + 1) <= doc:  # an equal set with no larger id has gone ahead
                continue
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen[digest] = doc
            often = sketch[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((h, often))
            rare = n - -(-percent * n // 100) + 1
            count = 0
            if n < light:
                own = order[: min(n, rare + 1)]
                i, j = np.triu_indices(len(own), 1)
                keys.append(_mix(h[own[i]] * _P + h[own[j]]))
                oftens.append(np.minimum(often[own[i]], often[own[j]]))
                most.append(n - j + 1)
                count += len(i)
            if 100 * n >= percent * light:
                own = order[:rare]
                keys.append(h[own])
                oftens.append(often[own])
                most.append(n - np.arange(len(own)))
                count += len(own)
            docs.append((doc, digest, n, count))
        if not docs:
            continue
        of = np.repeat(np.arange(len(docs)), [d[3] for d in docs])
        digest = np.array([d[1] for d in docs], np.uint64)[of]
        parts = np.maximum(1, np.ceil((np.concatenate(oftens) - beyond) / HOT)).astype(np.int64)
        values = [
            np.concatenate(keys).view(np.int64),
            (digest % parts.astype(np.uint64)).astype(np.int32),
            parts.astype(np.int32),
            np.array([d[2] for d in docs], np.int64)[of] << 32 | np.concatenate(most).astype(np.int64),
            digest.view(np.int64),
            np.array([d[0] for d in docs], np.int64)[of],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=ENTRY)


def _compared(batches: Iterator[pa.RecordBatch], turn: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by list and size: pairs to compare, and the entries of lists that are not done with them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        key, part = now.column("key").to_numpy(), now.column("part").to_numpy()
        change = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        last = int(change[-1]) + 1 if len(change) else 0  # the last run may go on
        if last:
            yield from _pairs_of(now.slice(0, last), turn, percent).to_batches()
        held = now.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield from _pairs_of(held, turn, percent).to_batches()


def _pairs_of(table: pa.Table, turn: int, percent: int) -> pa.Table:
    """Columns of MET_SCHEMA: rows of pairs, then rows of entries, the other half null."""
    e = {c: table.column(c).to_numpy() for c in table.column_names}
    run = _runs(e["key"], e["part"])
    repeat = np.zeros(len(run), bool)
    repeat[1:] = (run[1:] == run[:-1]) & (e["meta"][1:] == e["meta"][:-1]) & (e["digest"][1:] == e["digest"][:-1])
    e, run = {c: v[~repeat] for c, v in e.items()}, run[~repeat]

    # Entries for which another of their list has a size that their own size and largest overlap allow.
    n, most = e["meta"] >> 32, e["meta"] & 0xFFFFFFFF
    place = run << 31 | n  # ascending, as the entries are
    least = -(-percent * n // 100)
    largest = np.minimum(100 * n // percent, most * (100 + percent) // percent - n)
    others = np.searchsorted(place, run << 31 | largest, side="right") - np.searchsorted(place, run << 31 | least)
    keep = (others > (largest >= n)) | (e["parts"] > 1)
    e = {c: v[keep] for c, v in e.items()}
    n, most, run = n[keep], most[keep], _runs(e["key"], e["part"])
    label = e.get("component", e["id"])

    def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        ok &= np.minimum(most[x], most[y]) * (100 + percent) >= (n[x] + n[y]) * percent
        return x[ok], y[ok]

    starts = np.flatnonzero(np.diff(run, prepend=-1))
    ends = np.append(starts[1:], len(run))
    short = np.repeat(ends - starts <= SHORT, ends - starts)
    found = [(np.empty(0, np.int64),) * 2]
    for d in range(1, SHORT):
        x = np.flatnonzero(short[d:] & (run[d:] == run[:-d]))
        found.append(fit(x, x + d))
    left = e["parts"] > 1
    for s, t in zip(starts[ends - starts > SHORT], ends[ends - starts > SHORT], strict=True):
        own = np.unique(label[s:t], return_counts=True)[1]
        if len(own) == 1:
            continue
        if (few := _few(s, t, fit)) is not None:
            found.append(few)
            continue
        left[s:t] = True
        kind = np.floor(np.log(n[s:t]) / np.log(100 / percent)).astype(np.int64)
        h = _mix(e["digest"][s:t].view(np.uint64) ^ np.uint64(turn))
        for k in np.unique(kind):
            own, near = np.flatnonzero(kind == k), np.flatnonzero((kind == k) | (kind == k + 1)) + s
            # Members with few rarer shingles ahead of the list's are little changed and link with most others.
            ranked = own[np.lexsort((h[own], (n - most)[s:t][own]))]
            first = HEADS * turn % len(ranked)
            for head in {*ranked[first : first + HEADS].tolist(), int(own[np.argmin(h[own])])}:
                found.append(fit(near, np.full(len(near), head + s)))
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    x, y = np.where(e["digest"][x] < e["digest"][y], x, y), np.where(e["digest"][x] < e["digest"][y], y, x)
    pairs = np.unique(np.stack([e["id"][x], e["digest"][x], e["id"][y], e["digest"][y]], 1), axis=0) if len(x) else np.empty((0, 4), np.int64)
    none, rest = pa.nulls(int(left.sum()), pa.int64()), len(pairs)
    columns = [pa.chunked_array([pa.array(np.ascontiguousarray(pairs[:, i])), none]) for i in range(4)]
    columns += [pa.chunked_array([pa.nulls(rest, kind), pa.array(e[c][left])]) for c, kind in zip(ENTRY, ENTRY_TYPES, strict=True)]
    return pa.Table.from_arrays(columns, names=[*PAIR, *ENTRY])


def _few(s: int, t: int, fit: Callable[..., tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """All fitting pairs of the run from s to t, if they are few for its length."""
    found, total, rows = [], 0, max(1, (1 << 18) // (t - s))
    for a in range(s, t, rows):
        x, y = np.meshgrid(np.arange(a, min(t, a + rows)), np.arange(a, t), indexing="ij")
        later = y > x
        found.append(fit(x[later], y[later]))
        total += len(found[-1][0])
        if total > CROSS * (t - s):
            return None
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return x, y


def _runs(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The number of each entry's run of equal key and part."""
    change = np.zeros(len(key), np.int64)
    change[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return np.cumsum(change)


def _links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a written table) whose sets are similar enough: a, b.

    Sets are made again from the texts, for the documents that stand in pairs: a
    filter of fixed size lets most others pass by unread, the joins the rest.
    """
    held = _bits(pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            at = batch.column(2).to_numpy().astype(np.int64)
            hit = (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            digests, sets = [], []
            for text in batch.column(1).filter(pa.array(hit.astype(bool))).to_pylist():
                h = shingles(text)
                digest = xxhash.xxh3_64_intdigest(h.tobytes())
                if digest not in seen:
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add(digest), digests.append(digest), sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "set"])

    sets = docs.select("id", "text", _bit("id").alias("bit")).mapInArrow(of, "digest long, set array<long>")
    both = pairs.join(sets.select(F.col("digest").alias("da"), F.col("set").alias("sa")), "da")
    both = both.join(sets.select(F.col("digest").alias("db"), F.col("set").alias("sb")), "db")
    overlap = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), (F.size("sa") + F.size("sb")).alias("n"))
    return overlap.where(F.col("o") * (100 + percent) >= F.col("n") * percent).select("a", "b")


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _bits(ids: DataFrame) -> Broadcast[np.ndarray]:
    """A filter of fixed size, one bit an id, as words."""
    one = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))")
    words = ids.select(F.shiftright(_bit("id"), 6).alias("w"), one.alias("o")).groupBy("w").agg(F.bit_or("o").alias("o"))
    words = words.toArrow()  # at most FILTER_BITS / 64 rows
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("o").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(held.view(np.uint64))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles (set size), component_id (smallest id reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union. A text without
    words, or a null, has an empty set and links with nothing. Rows that repeat an
    id are one vertex with the links of each of its texts. A null id links with
    nothing and has no component. Other columns of docs are ignored. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    mixed = written(docs.mapInArrow(_profile, "id long, n int, digest binary, slice int, counts binary"), "profile")
    profile = mixed.where("slice is null").select("id", "n", "digest")
    slices = mixed.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(_add_slices, "slice int, counts binary")
    sketch = np.zeros(SKETCH, np.int64)
    for s, counts in slices.collect():  # SLICES rows
        sketch[s * (SKETCH // SLICES) : (s + 1) * (SKETCH // SLICES)] = np.frombuffer(counts, np.int64)
    light = boundary(sketch, percent)
    held = spark.sparkContext.broadcast(sketch)

    # Equal sets are one vertex, their first id. The classes are written, so that Spark can split the join where a class holds many rows.
    classes = profile.where("n > 0 and id is not null").groupBy("n", "digest").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    classes = written(classes.where("c > 1").drop("c"), "classes")
    rows = profile.join(classes, ["n", "digest"], "left").select("id", "n", F.coalesce("first", "id").alias("first"))
    rows = written(rows, "rows")
    # An id with several texts links the classes of all of them.
    several = rows.where("id is not null").groupBy("id").agg(F.min("first").alias("b"), F.max("first").alias("most")).where("b < most").select("id", "b")
    found = rows.join(several, "id").select(F.col("first").alias("a"), "b")

    known = docs.where("id is not null")
    entries = known.mapInArrow(lambda b: _entries(b, held.value, light, percent), ENTRY_SCHEMA)
    for turn in range(ROUNDS):
        compared = entries.repartition("key", "part").sortWithinPartitions("key", "part", "meta", "digest", "id")
        compared = compared.mapInArrow(lambda b, t=turn: _compared(b, t, percent), MET_SCHEMA)
        met = written(compared, "met")
        pairs = written(met.where("a is not null").select(*PAIR).distinct(), "pairs")
        links, new = written_with(_links(known, pairs, percent), "links", {"n": F.count("*")})
        found = components(links.union(found), "found")
        placed = written(_placed(met.where("key is not null").select(*ENTRY), found), "placed")
        found = found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))

        # Lists that still hold more than one component.
        sizes = placed.groupBy("key", "component").agg(F.count("*").cast("double").alias("c"))
        sizes = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        apart = ((F.col("c") * F.col("c") - F.col("own")) / 2).alias("apart")
        totals = {"lists": F.count("*"), "members": F.sum("c"), "apart": F.sum("apart")}
        mixed, total = written_with(sizes.select("key", "c", apart).where("apart > 0"), "mixed", totals)
        if not total["lists"]:
            return _labelled(rows, found, id_col)
        entries = placed.join(mixed.select("key"), "key", "left_semi")
        if total["apart"] <= CROSS * total["members"] or new["n"] * LEAST_FOUND <= total["members"]:
            break
        # Long lists are dealt anew, so that others meet.
        entries = entries.withColumn("part", F.pmod(F.xxhash64("digest", F.lit(turn + 1)), F.col("parts")).cast("int")).select(*ENTRY, "component")

    # What lies apart in a list is compared as it is.
    rest = written(entries, "rest")
    x, y = (rest.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "digest", "meta", "component")]) for s in "xy")
    met = x.join(y, "key").where((F.col("digest_x") < F.col("digest_y")) & (F.col("component_x") != F.col("component_y")) & _fits("meta_x", "meta_y", percent))
    pairs = written(met.select(*[F.col(c).alias(p) for c, p in zip(("id_x", "digest_x", "id_y", "digest_y"), PAIR, strict=True)]).distinct(), "pairs")
    found = components(written(_links(known, pairs, percent), "links").union(found), "found")
    return _labelled(rows, found.select(F.col("id").alias("a"), F.col("component_id").alias("b")), id_col)


def _placed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """List entries with the component of their id."""
    labels = found.withColumnRenamed("component_id", "component")
    return entries.join(labels, "id", "left").select(*ENTRY, F.coalesce("component", "id").alias("component"))


def _labelled(rows: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    label = F.when(F.col("id").isNotNull(), F.coalesce("b", "first"))
    out = rows.join(found.select(F.col("a").alias("first"), "b"), "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), label.alias("component_id"))


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether two entries of a list can belong to similar sets, by their sizes and the overlap still possible."""
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    most = F.least(F.col(x).bitwiseAND(0xFFFFFFFF), F.col(y).bitwiseAND(0xFFFFFFFF))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)
