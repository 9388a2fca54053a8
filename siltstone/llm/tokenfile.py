"""Token files: documents' ids in ascending doc_id order, range coded in independent, checksummed blocks.

A file: the magic, the blocks' bytes, a zlib-packed footer (vocabulary size, the block table: bytes, ids and crc32 of
each block; the documents' ids, whether they are null, and their lengths), the footer's length and crc32, the magic.
Documents may span blocks, not files. A writer's task takes a range of doc_id and starts a new file after about
FILE_IDS ids; a manifest row names each file with its place in the order, so that prefix sums over the manifest give
every file's first id.

Defined cases: null text is empty, so it has the end id alone; null doc_ids come first; rows with equal doc_id come
in the order of their text's hash; an empty table writes no file; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import coder
from siltstone.llm.common import binary_slices, byte_slices, fresh, write_file, written
from siltstone.llm.encode import encoder

MAGIC = b"SILTTOK1"
FILE_IDS = 4 << 20
SLICE = 4 << 20
MANIFEST = "part int, number int, name string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


class Damaged(ValueError):
    """A block or a footer whose checksum is wrong."""


def dump(names: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """A file's parts."""
    blocks = [ids[a : a + coder.BLOCK] for a in range(0, len(ids), coder.BLOCK)]
    bodies = coder.encode(blocks, vocabulary)
    table = np.array([(len(b), len(x), zlib.crc32(b)) for b, x in zip(bodies, blocks, strict=True)], "<u4")
    doc_ids = np.array([x or 0 for x in names], "<i8")
    nulls = np.array([x is None for x in names], np.uint8)
    head = np.array([vocabulary, len(blocks), len(names)], "<u8")
    footer = zlib.compress(head.tobytes() + table.tobytes() + doc_ids.tobytes() + nulls.tobytes() + lengths.astype("<i8").tobytes(), 6)
    return [MAGIC, *bodies, footer, len(footer).to_bytes(8, "little"), zlib.crc32(footer).to_bytes(4, "little"), MAGIC]


def load(data: bytes | memoryview) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """doc_ids, lengths, and the ids in pieces of some blocks each."""
    data = memoryview(data).cast("B")
    if len(data) < 28 or data[:8] != MAGIC or data[-8:] != MAGIC:
        raise Damaged("no token file")
    size = int.from_bytes(data[-20:-12], "little")
    footer = data[len(data) - 20 - size : -20]
    if zlib.crc32(footer) != int.from_bytes(data[-12:-8], "little"):
        raise Damaged("footer")
    plain = zlib.decompress(footer)
    vocabulary, n_blocks, n_docs = np.frombuffer(plain, "<u8", 3).astype(int).tolist()
    table = np.frombuffer(plain, "<u4", 3 * n_blocks, 24).reshape(-1, 3).astype(np.int64)
    at = 24 + 12 * n_blocks
    doc_ids = np.frombuffer(plain, "<i8", n_docs, at)
    nulls = np.frombuffer(plain, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(plain, "<i8", n_docs, at + 9 * n_docs)

    def pieces() -> Iterator[np.ndarray]:
        ends = 8 + np.cumsum(table[:, 0])
        step = coder.lanes_for(n_blocks, vocabulary)
        for a in range(0, n_blocks, step):
            bodies = []
            for i in range(a, min(n_blocks, a + step)):
                body = bytes(data[int(ends[i] - table[i, 0]) : int(ends[i])])
                if zlib.crc32(body) != table[i, 2]:
                    raise Damaged(f"block {i}")
                bodies.append(body)
            yield np.concatenate(coder.decode(bodies, table[a : a + step, 1].tolist(), vocabulary))

    return [None if z else x for x, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], lengths, pieces()


def write_batches(tokenizer: str, folder: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, attempt, number = encoder(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        vocabulary = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        names, parts, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, names, parts, lengths, held
            name = f"part-{part:06d}-{number:05d}-{attempt}.tok"
            write_file(f"{folder}/{name}", *dump(names, np.array(lengths), np.concatenate(parts), vocabulary))
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "name": name, "docs": len(names), "ids": held}], schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))
            number, names, parts, lengths, held = number + 1, [], [], [], 0
            return row

        for b in batches:
            for some in byte_slices(b, 1, SLICE):
                flat, counts = enc.column(some.column(1))
                at = np.cumsum(counts)
                parts.append(np.insert(flat, at, end_id))
                names += some.column(0).to_pylist()
                lengths += (counts + 1).tolist()
                held += len(parts[-1])
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    return run


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end_id: int = 2, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest (written to folder + "-manifest"), in order by part and number."""
    docs = documents.select("doc_id", "text")
    partitions = partitions or max(1, docs.rdd.getNumPartitions())
    order = ["doc_id", "h", "place"]
    docs = docs.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = docs.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(write_batches(tokenizer, folder, end_id, file_ids), MANIFEST), "manifest", f"{folder}-manifest")


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        for body, first in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            names, lengths, pieces = load(body.as_buffer())
            ends = np.cumsum(lengths)
            starts = (first + ends - lengths).tolist()
            done, held, at = 0, np.zeros(0, np.int32), 0
            for piece in pieces:
                held = np.concatenate((held, piece))
                to = int(np.searchsorted(ends, at + len(held), side="right"))
                edges = np.append(0, 4 * (ends[done:to] - at))
                bodies = binary_slices(held.astype("<u4"), edges)
                yield pa.RecordBatch.from_arrays([pa.array(names[done:to], pa.int64()), pa.array(starts[done:to], pa.int64()), pa.array(lengths[done:to]), bodies], schema=schema)
                held = held[int(edges[-1]) // 4 :]
                done, at = to, at + int(edges[-1]) // 4


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file: a few numbers for some 4 million ids
    firsts = manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("name", "first")
    if firsts.isEmpty():
        return spark.createDataFrame([], ROWS)
    files = spark.read.format("binaryFile").load(folder).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(firsts, "name").select("content", "first").mapInArrow(read_batches, ROWS)


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the files to a fresh folder that all machines share and reads them back."""
    spark = documents.sparkSession
    folder = fresh(spark, "tokens")
    write_tokens(documents, tokenizer, folder, end_id)
    return read_tokens(spark, folder)
