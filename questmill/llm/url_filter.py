"""URL lists as Bloom filter cascades, in DataFrame functions only.

Level 1 encodes the listed keys. Level 2 encodes those keys of the corpus that
pass level 1 without being listed, level 3 the listed keys that pass level 2,
and so on until nothing passes wrongly. As every key that is ever asked was in
the universe when the cascade was built, the answer is exact, and asking takes a
few bit tests in the scan: no join, no shuffle. A level's size follows from the
list and the logarithm of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter at most (256 MB). A list of more than some 10^8 keys lets more keys pass a level wrongly, which further
#: levels put right: the answer stays exact.
MOST_BITS = 1 << 31
#: Words of a filter that are gathered in one group.
CHUNK = 1 << 10


#: Before keys that are whole urls, so that they are told from rules.
_WHOLE = "="


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: DataFrame  # one row: arrays of CHUNK longs each, null where all bits are 0

    def passes(self, words: Column, key: Column, seed: int) -> Column:
        """Whether all bits of the key are set in words, this level's."""
        test = F.lit(True)
        for bit in _bits(key, seed, self.hashes, self.bits):
            word = F.shiftright(bit, 6).cast("int")
            word = F.get(F.get(words, (word / CHUNK).cast("int")), word % CHUNK)
            test = test & (F.getbit(F.coalesce(word, F.lit(0).cast("long")), (bit % 64).cast("int")) == 1)
        return test


def _bits(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    """The bits of a key at one level, by double hashing."""
    first = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 32)
    step = F.shiftrightunsigned(F.xxhash64(key, F.lit(-seed)), 32)
    return [(first + F.lit(i) * step) % F.lit(bits) for i in range(hashes)]


def _array(place: Column, value: str, size: int, missing: Column) -> Column:
    """The values of a group as an array of this size, by their places."""
    by_place = F.map_from_entries(F.collect_list(F.struct(place, value)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at(by_place, k), missing))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys with about this rate of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    bits = min(MOST_BITS, max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64))
    at = F.explode(F.array(*_bits(F.col("key"), seed, hashes, bits)))
    ones = keys.select(at.alias("bit")).select(
        F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one")
    )
    words = ones.groupBy("word").agg(F.bit_or("one").alias("ones"))
    chunks = words.groupBy((F.col("word") / CHUNK).cast("int").alias("chunk")).agg(_array((F.col("word") % CHUNK).alias("k"), "ones", CHUNK, F.lit(0).cast("long")).alias("words"))
    words = chunks.agg(_array(F.col("chunk").alias("k"), "words", -(-bits // 64 // CHUNK), F.lit(None).cast("array<long>")).alias("words"))
    return Level(bits, hashes, written(words, "bloom"))


class Cascade:
    """Exact membership of a list, for all keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed and universe: one column key each, nulls and repeats allowed; the list need not lie in the universe."""
        listed = written(listed.where("key is not null").distinct(), "listed")
        n = listed.count()
        if not n:
            return cls([])
        size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
        levels = [_level(listed, n, min(0.5, max(n / size / math.sqrt(2), 1e-9)), 1)]
        passing = lambda keys: _asked(keys, levels[-1:], F.array("key"), "_passes", lambda words, key: levels[-1].passes(words[0], key, len(levels))).where("_passes[0]").select("key")
        wrong = passing(universe.where("key is not null")).distinct()
        inside, wrong = listed, written(wrong.join(listed, "key", "left_anti"), "wrong")
        while k := wrong.count():
            levels.append(_level(wrong, k, 0.5, len(levels) + 1))
            inside, wrong = wrong, written(passing(inside), "wrong")
        return cls(levels)

    def members(self, frame: DataFrame, keys: Column, name: str) -> DataFrame:
        """frame with a column of this name: for each of the keys (an array) whether it is listed; a null key is not."""

        def answer(words: list[Column], key: Column) -> Column:
            out = F.lit(False)
            for at, level in reversed(list(enumerate(self.levels))):
                out = level.passes(words[at], key, at + 1) & ~out
            return F.coalesce(out & key.isNotNull(), F.lit(False))

        if not self.levels:
            return frame.withColumn(name, F.transform(keys, lambda _: F.lit(False)))
        return _asked(frame, self.levels, keys, name, answer)

    def listed(self, frame: DataFrame, key: str) -> DataFrame:
        """The rows of frame whose key is listed."""
        return self.members(frame, F.array(key), "_listed").where("_listed[0]").drop("_listed")


def _asked(frame: DataFrame, levels: list[Level], keys: Column, name: str, answer: Callable[[list[Column], Column], Column]) -> DataFrame:
    """frame with the answer for each of the keys, given the words of the levels; the plan holds each level once, however many keys and bits there are."""
    words = F.struct(*[level.words.scalar().alias(f"w{i}") for i, level in enumerate(levels)])
    held = [F.col("_words")[f"w{i}"] for i in range(len(levels))]
    return frame.withColumn("_words", words).withColumn(name, F.transform(keys, lambda key: answer(held, key))).drop("_words")


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> list[Column]:
    """The keys a rule for this URL can have: the last k labels of the host and the first m characters of the path; else null."""
    has = F.size(F.split(host, r"\."))
    return [
        F.when((has >= k) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, m)))
        for k in sorted(set(labels))
        for m in sorted(set(lengths))
    ]


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    blocked_hosts: DataFrame,
    host_labels: Sequence[int],
    url_col: str = "url",
    blocked_urls: DataFrame | None = None,
) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (allow or block, host, path); a rule fits its host and subdomains when
    the path starts with the rule's; the longest that fits wins. blocked_hosts:
    column key, hosts that are blocked with their subdomains where no rule fits;
    host_labels: the numbers of labels that these hosts have. blocked_urls: column
    key, host and path together, blocked likewise. A null url, or one without
    ://, has an empty host and path, fits no rule and is allowed if the lists do
    not name it. Very long urls are read whole. Columns named host, path, rule or
    verdict in pages are replaced, others stay. Repeated rows stay.
    """
    spark: SparkSession = pages.sparkSession
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    labels, lengths = [len(h.split(".")) for _, h, _ in rules], [len(p) for *_, p in rules]
    split = pages.select(host.alias("h"), path.alias("p")).distinct()
    fits = candidates(F.col("h"), F.col("p"), labels, lengths)
    hosts = candidates(F.col("h"), F.lit(""), host_labels, [0])
    whole = lambda host, path: F.concat(F.lit(_WHOLE), host, path)
    universe = split.select(F.explode(F.array(*fits, *hosts, whole(F.col("h"), F.col("p")))).alias("key"))
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    known = Cascade.build(frame([h + p for _, h, p in rules]), universe)
    listed = frame([h + p for v, h, p in rules if v == "block"]).union(blocked_hosts.select("key"))
    if blocked_urls is not None:
        listed = listed.union(blocked_urls.select(F.concat(F.lit(_WHOLE), "key")))
    blocked = Cascade.build(listed, universe)

    out = pages.withColumns({"host": host, "path": path})
    fits = candidates(F.col("host"), F.col("path"), labels, lengths)
    out = known.members(out, F.array(*fits), "_hits") if fits else out
    named = F.zip_with(F.array(*fits), "_hits", lambda k, hit: F.when(hit, F.struct(F.length(k).alias("n"), k.alias("k")))) if fits else None
    out = out.withColumn("rule", F.array_max(named)["k"] if fits else F.lit(None).cast("string"))
    hosts = candidates(F.col("host"), F.lit(""), host_labels, [0])
    hosts += [whole(F.col("host"), F.col("path"))] if blocked_urls is not None else []
    asked = F.when(F.col("rule").isNotNull() | F.lit(not hosts), F.array("rule")).otherwise(F.array(*hosts) if hosts else F.array("rule"))
    out = blocked.members(out.withColumn("_asked", asked), F.col("_asked"), "_listed")
    return out.withColumn("verdict", F.when(F.exists("_listed", lambda hit: hit), "block").otherwise("allow")).drop("_hits", "_asked", "_listed")
