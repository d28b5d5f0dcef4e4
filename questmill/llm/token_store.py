"""Token files: fixed-width bit packing with block offsets.

A store is a folder of Parquet files whose rows are blocks. A block holds whole
documents in ascending id order: their ids, their token counts, where the block
starts in its shard, and the tokens in the fewest bits that the vocabulary needs,
one after another from the lowest bit of the first byte. Token k of a block
stands at bit k * bits, so any document is read without its neighbours, and a
block unpacks in one numpy expression. Shards follow one another in id order, so
a document's place in the whole is its shard's base plus its place in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questmill.llm.common import in_slices
from questmill.llm.tokens import encoder

#: Tokens of a block, when its last document ends.
BLOCK_TOKENS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, start long, doc_ids array<long>, counts array<int>, bits int, payload binary"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(spread, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """count ids from the id at place first on."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low = first * bits
    part = np.frombuffer(payload, np.uint8)[low // 8 : (low + count * bits + 7) // 8]
    ones = np.unpackbits(part, bitorder="little")[low % 8 : low % 8 + count * bits].reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = ones
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, bits: int, end: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard, from its documents in order."""
    shard, block, start, tokens = TaskContext.get().partitionId(), 0, 0, 0
    docs, counts, parts = [], [], []
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
         ("counts", pa.list_(pa.int32())), ("bits", pa.int32()), ("payload", pa.binary())]
    )

    def row() -> pa.RecordBatch:
        payload = pack(np.concatenate(parts), bits)
        values = [[shard], [block], [start], [docs], [counts], [bits], [payload]]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, schema, strict=True)], schema=schema)

    for batch in in_slices(batches):
        ids, sizes = encoder(path).encode(batch.column(1).to_pylist())
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for i, doc in enumerate(batch.column(0).to_pylist()):
            parts += [ids[edges[i] : edges[i + 1]], np.array([end], np.uint32)]
            docs.append(doc)
            counts.append(int(sizes[i]) + 1)
            tokens += counts[-1]
            if tokens >= BLOCK_TOKENS:
                yield row()
                block, start, tokens = block + 1, start + tokens, 0
                docs, counts, parts = [], [], []
    if docs:
        yield row()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the tokens of every text, each followed by the id end, as a store at path, in ascending id order.

    A null text is an empty one and holds just the end; a null id comes first;
    rows that repeat an id stand side by side. Other columns are ignored. An
    empty table gives a store without blocks.
    """
    bits = bits_for(vocabulary)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(lambda b: _blocks(b, tokenizer, bits, end), BLOCK_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and tokens of a store."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    bases = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each file of the store.
    placed = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "counts", "bits", "payload")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["bits"], sum(b["counts"]))
                edges = np.concatenate([[0], np.cumsum(b["counts"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array(b["start"] + edges[:-1].astype(np.int64)),
                        pa.array(np.diff(edges).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int64))),
                    ],
                    names=["doc_id", "start", "n_tokens", "tokens"],
                )

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, tokens array<long>")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """doc_id and tokens of the documents with these ids: only their blocks are read, and of these only their bits are unpacked."""
    wanted = set(ids)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    some = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted]))) if wanted else blocks.where("false")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            for b in batch.to_pylist():
                ends = np.cumsum(b["counts"])
                at = [k for k, doc in enumerate(b["doc_ids"]) if doc in wanted]
                found = [unpack(b["payload"], b["bits"], b["counts"][k], int(ends[k]) - b["counts"][k]).astype(np.int64) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([b["doc_ids"][k] for k in at], pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    return some.select("doc_ids", "counts", "bits", "payload").mapInArrow(rows, "doc_id long, tokens array<long>")


def crc_of_tokens(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            tokens = batch.column("tokens")
            flat, edges = tokens.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(batch.column("n_tokens"))])
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
