"""Near-duplicate vectors by product quantisation.

Vectors with equal labels and equal components are one class. A coarse codebook
deals the classes to inverted lists; each holds, for its members, the codes of
the residual's subspaces and the length of what the codes leave over. A vector
looks into every list that can hold a vector close enough: all lists whose
bisector with its own list lies within the search radius. There a table of
distances from its residual to all code words gives each member's approximate
distance; by the triangle inequality, members farther than the radius plus their
own leftover can't be close. The rest are compared by exact cosine in double
precision. So the search loses nothing, whatever the codebooks are worth; these
only decide how much work there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questmill.llm.common import components, written

#: Vectors the codebooks are fitted on: so many for each inverted list, but no fewer and no more than these, about.
PER_LIST, LEAST_SAMPLE, MOST_SAMPLE = 8, 20_000, 200_000
#: Members of a list that meet in one task with SEARCHERS as many searchers.
BLOCK, SEARCHERS = 4096, 4
SUBSPACES, WORDS = 8, 64


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of the rows of x."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(p, centres).argmin(1) for p in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.empty(0, int)


class Codebooks:
    """Coarse centres, and code words for each subspace of what they leave over."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, words: int = WORDS):
        self.centres = k_means(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.words = [k_means(rest[:, c], words) for c in self.cuts]
        self.gaps = np.sqrt(_squares(self.centres, self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the leftover of each row."""
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([_nearest(rest[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], 1)
        guess = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        return at, codes.astype(np.uint8), np.sqrt(((rest[:, np.concatenate(self.cuts)] - guess) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of all later lists that can hold a vector within the radius of a row, and its own."""
        d = _squares(x, self.centres)
        lead = d - d[np.arange(len(x)), own][:, None]
        near = (lead <= 2 * radius * self.gaps[own] + 1e-9) & (np.arange(len(self.centres)) >= own[:, None])
        near[np.arange(len(x)), own] = True
        return np.nonzero(near)

    def distances(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Approximate distances of rows of x to the members of a list with these codes, by table look-up."""
        rest = x - self.centres[of]
        total = np.zeros((len(x), len(codes)))
        for m, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            total += _squares(rest[:, c], w)[:, codes[:, m]]
        return np.sqrt(total)



def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def scaled(vecs: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component lies between a half and one and squares neither vanish nor overflow."""
    return np.ldexp(vecs, -np.frexp(np.abs(vecs).max(1))[1][:, None])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component; a and b are ends of edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(part: pa.Table, books: Codebooks, cosine: float, radius: float) -> pa.Table:
    """Links between the members and the searchers of one block of a list: id, links (of other vectors), root."""
    dim = books.centres.shape[1]
    part = part.combine_chunks()
    member = part.column("member").to_numpy()
    ids, sizes, own = (part.column(c).to_numpy() for c in ("id", "size", "own"))
    vecs = _matrix(part.column("vec").combine_chunks(), dim)
    m, q = np.flatnonzero(member), np.flatnonzero(~member)
    unit = vecs / np.sqrt((vecs**2).sum(1))[:, None]
    codes = np.frombuffer(b"".join(part.column("codes").take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
    over, of = part.column("over").to_numpy()[m], int(part.column("list")[0].as_py())
    xs, ys = [], []
    for rows in np.array_split(q, max(1, len(q) // 512)):
        if not len(rows) or not len(m):
            continue
        near = books.distances(unit[rows], of, codes) <= radius + over + 1e-6
        near &= (own[rows] != of)[:, None] | (ids[rows][:, None] < ids[m])  # each pair once
        i, j = np.nonzero(near)
        x, y = rows[i], m[j]
        dot = np.einsum("ij,ij->i", vecs[x], vecs[y])
        exact = dot / np.sqrt((vecs[x] ** 2).sum(1) * (vecs[y] ** 2).sum(1)) >= cosine
        xs.append(x[exact]), ys.append(y[exact])
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
    names, at = np.unique(ids, return_inverse=True)
    links = np.bincount(at[x], sizes[y], len(names)) + np.bincount(at[y], sizes[x], len(names)) if len(x) else np.zeros(len(names))
    root = _forest(len(names), at[x], at[y])
    hit = links > 0
    return pa.table({"id": names[hit], "links": links[hit].astype(np.int64), "root": names[root[hit]]})


def embedding_components(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of vectors: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Only vectors with equal labels that are not null, and as many components,
    are compared, whatever their magnitude. A vector that is null, empty or zero,
    or holds a null or non-finite component, links with nothing, as does a null
    id. Rows that repeat an id are vectors of their own that share its component.
    Other columns are ignored. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")]
    every = vectors.select(*cols)
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    # Minus zero counts as zero. A vector is known by two hashes of 64 bits, so that only these are joined.
    vec = F.transform("vec", lambda v: v + F.lit(0.0))
    rows = every.where(sound).select("id", "label", vec.alias("vec")).withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    key = ["label", "h1", "h2"]
    classes = written(rows.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("size"), F.any_value("vec").alias("vec")), "classes")
    found = []
    for dim in [r[0] for r in classes.select(F.size("vec")).distinct().collect()]:
        found.append(_search(classes.where(F.size("vec") == dim), dim, cosine))
    none = spark.createDataFrame([], "id long, links long, root long")
    met = written(found[0] if len(found) == 1 else none if not found else _union(found), "met")

    comps = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select(*key, "first", "size").join(links.withColumnRenamed("id", "first"), "first", "left")
    of_class = of_class.join(comps.withColumnRenamed("id", "first"), "first", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
    )
    # Written, so that Spark can split the join where many rows hold one vector.
    linked = rows.select("id", *key).join(written(of_class, "linked"), key)
    alone = every.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _rows(vecs: DataFrame, dim: int) -> np.ndarray:
    return _matrix(vecs.toArrow().column("vec").combine_chunks(), dim)


def _search(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """id, links, root of the classes with one number of components, from every block of every list."""
    spark = classes.sparkSession
    # A vector meets those of its label; as many lists as the square root of their mean number.
    sizes = classes.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    n, squares = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    lists = max(1, min(MOST_SAMPLE // PER_LIST, int(np.sqrt(squares / n))))
    share = min(1.0, min(MOST_SAMPLE, max(LEAST_SAMPLE, PER_LIST * lists)) / n)
    picked = classes.where(F.pmod(F.xxhash64("first"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("vec")
    sample = _rows(picked, dim)  # about MOST_SAMPLE vectors at most
    if not len(sample):
        sample = _rows(classes.select("vec").limit(LEAST_SAMPLE), dim)
    sample /= np.sqrt((sample**2).sum(1))[:, None]
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    books = spark.sparkContext.broadcast(Codebooks(sample, lists))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _matrix(batch.column("vec"), dim)
            unit = raw / np.sqrt((raw**2).sum(1))[:, None]
            own, codes, over = books.value.encode(unit)
            row, to = books.value.probes(unit, own, radius)
            both = np.concatenate([np.arange(len(raw)), row]).astype(np.int64)
            member = np.concatenate([np.ones(len(raw), bool), np.zeros(len(row), bool)])
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            pick = batch.take(pa.array(both))
            yield pa.RecordBatch.from_arrays(
                [
                    pick.column("part"), pa.array(np.concatenate([own, to]).astype(np.int32)), pa.array(member), pick.column("first"),
                    pick.column("size"), pick.column("vec"), packed.take(pa.array(both)), pa.array(over[both]), pa.array(own[both].astype(np.int32)),
                ],
                names=["label", "list", "member", "id", "size", "vec", "codes", "over", "own"],
            )

    plain = classes.select(F.col("label").alias("part"), "first", "size", "vec")
    listed = plain.mapInArrow(
        entries, "label string, list int, member boolean, id long, size long, vec array<double>, codes binary, over double, own int"
    )
    # Long lists meet in blocks: members and searchers are dealt evenly, and each block of one meets each of the other.
    lengths = listed.groupBy("label", "list").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    blocks = lengths.select(
        "label", "list", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / (SEARCHERS * BLOCK)).cast("int").alias("qb")
    ).where("mb > 0 and qb > 0")
    dealt = listed.join(blocks, ["label", "list"])
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt = dealt.withColumn(
        "meets",
        F.when(F.col("member"), F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda k: F.struct(spread("mb").alias("mine"), k.alias("theirs"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda k: F.struct(k.alias("mine"), spread("qb").alias("theirs")))),
    ).select("*", F.inline("meets")).drop("meets", "mb", "qb")
    return dealt.groupBy("label", "list", "mine", "theirs").applyInArrow(
        lambda t: _meet(t, books.value, cosine, radius), "id long, links long, root long"
    )
