"""Benchmark decontamination by a distributed positional inverted index.

build() reads the training texts once and writes one row for each shard (some 2^20 words of neighbouring documents):
its documents' ids and first words, its distinct terms in order of their hash, and their postings (positions in the
shard, as LEB128 differences). Nothing is exchanged, and the index is a table that can be searched again.

search() takes the test texts as the query set, in blocks of at most BLOCK_BYTES (so what is broadcast is bounded),
and looks every window of them up in every shard: a window with a term that the shard lacks is passed over; for the
others the lists are moved by their term's place in the window and intersected, rarest term first. With a slack,
windows whose terms all lie within that many places of their own are returned as proximity matches too.

Defined cases: null and blank texts have no words; a test text with fewer words than a window is one window, with
none it is never found; repeated rows are rows of their own; repeated item ids count once; null item ids are not
listed, though what they cover is hit; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, byte_slices, delete, fresh, written
from siltstone.llm.filters import among_maybe
from siltstone.llm.words import ALNUM, word_hashes

SHARD_WORDS = 1 << 20
SLICE = 4 << 20
BLOCK_BYTES = 8 << 20
INDEX = "shard long, doc_ids binary, missing binary, firsts binary, terms binary, ends binary, postings binary"
FOUND = "shard long, place long, doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>, near array<struct<item_id:long,start:long,end:long>>"


def leb128(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned numbers below 2^35, seven bits each with the lowest first, and where each number ends."""
    values = values.astype(np.uint64)
    sizes = 1 + sum((values >= np.uint64(1 << 7 * i)).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - sizes
    for i in range(int(sizes.max(initial=0))):
        on = sizes > i
        out[first[on] + i] = (values[on] >> np.uint64(7 * i)) & np.uint64(127) | ((sizes[on] > i + 1) << 7).astype(np.uint64)
    return out, ends


def unleb128(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def shard_row(shard: int, doc_ids: list[int | None], hashes: np.ndarray, counts: np.ndarray) -> dict:
    order = np.argsort(hashes, kind="stable")
    terms, begin = np.unique(hashes[order], return_index=True)
    gaps = np.diff(order, prepend=0)
    if len(begin):
        gaps[begin] = order[begin]
    data, ends = leb128(gaps)
    stops = np.append(begin[1:], len(order)) - 1
    return {
        "shard": shard,
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        "missing": np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        "firsts": np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes(),
        "terms": terms.astype("<u8").tobytes(),
        "ends": (ends[stops] if len(begin) else ends).astype("<i8").tobytes(),
        "postings": data.tobytes(),
    }


INDEX_SCHEMA = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "missing", "firsts", "terms", "ends", "postings"))])


def index_batches(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        ids, hashes, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, ids, hashes, counts, held
            row = shard_row(shard, ids, np.concatenate(hashes), np.concatenate(counts))
            shard, ids, hashes, counts, held = shard + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=INDEX_SCHEMA)

        for b in batches:
            for some in byte_slices(b, 1, SLICE):
                h, n = word_hashes(some.column(1), ALNUM)
                ids += some.column(0).to_pylist()
                hashes.append(h)
                counts.append(n)
                held += len(h)
                if held >= shard_words:
                    yield flush()
        if ids:
            yield flush()

    return run


def build(documents: DataFrame, path: str | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Writes the index and returns it."""
    rows = documents.select("doc_id", "text").mapInArrow(index_batches(shard_words), INDEX)
    return written(rows, "postings", path or fresh(documents.sparkSession, "postings"))


class Queries:
    """The windows of test texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        hashes, counts = word_hashes(pa.array([t for _, t in items], pa.string()), ALNUM)
        ends = np.cumsum(counts)
        self.items, windows, self.item_of = [i for i, _ in items], [], []
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            words = hashes[end - count : end]
            for a in range(max(1, count - n + 1) if count else 0):
                windows.append(words[a : a + n])
                self.item_of.append(i)
        self.terms = np.unique(hashes)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        # each window's terms by number; places beyond a short window have the number of no term
        self.words = np.full((len(windows), n), len(self.terms), np.int64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = np.searchsorted(self.terms, w)


def contains(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return places[at] == wanted


def close(places: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    return np.searchsorted(places, wanted - slack) < np.searchsorted(places, wanted + slack, side="right")


class Shard:
    """One row of the index, with the lists of the query's terms."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.firsts = np.frombuffer(row["firsts"], "<i8")
        own, ends = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["ends"], "<i8")
        data = np.frombuffer(row["postings"], np.uint8)
        self.at = np.full(len(terms) + 1, -1, np.int64)
        if len(own):
            i = np.minimum(np.searchsorted(own, terms), len(own) - 1)
            self.at[:-1] = np.where(own[i] == terms, i, -1)
        self.ends, self.data, self.lists = ends, data, {}

    def size(self, term: int) -> int:
        """Bytes of a term's list, which stand for its length."""
        k = self.at[term]
        return int(self.ends[k] - (self.ends[k - 1] if k else 0))

    def places(self, term: int) -> np.ndarray:
        if term not in self.lists:
            k = self.at[term]
            self.lists[term] = np.cumsum(unleb128(self.data[self.ends[k - 1] if k else 0 : self.ends[k]]))
        return self.lists[term]

    def starts(self, terms: list[int], slack: int = 0) -> np.ndarray:
        """Where a window starts: exactly, or by its rarest term with all others within a slack of their places."""
        order = sorted(range(len(terms)), key=lambda j: self.size(terms[j]))
        found = self.places(terms[order[0]]) - order[0]
        for j in order[1:]:
            if not len(found):
                break
            found = found[close(self.places(terms[j]), found + j, slack) if slack else contains(self.places(terms[j]), found + j)]
        inside = (found >= 0) & (found + len(terms) <= self.firsts[-1])
        found = found[inside]
        doc = np.searchsorted(self.firsts, found, side="right")
        return found[self.firsts[doc] >= found + len(terms)]


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs that spans cover together."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


FOUND_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("near", pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])))]
)


def search_shard(row: dict, q: Queries, slack: int) -> pa.Table:
    shard = Shard(row, q.terms)
    have = shard.at >= 0
    have[-1] = True
    docs: dict[int, tuple[list, list, list]] = {}
    for w in np.flatnonzero(have[q.words].all(axis=1)).tolist():
        terms, item = q.words[w, : q.lengths[w]].tolist(), q.items[q.item_of[w]]
        exact = shard.starts(terms)
        near = np.setdiff1d(shard.starts(terms, slack), exact) if slack else exact[:0]
        for kind, found in ((0, exact), (1, near)):
            for p, d in zip(found.tolist(), (np.searchsorted(shard.firsts, found, side="right") - 1).tolist(), strict=True):
                at = p - int(shard.firsts[d])
                got = docs.setdefault(d, ([], [], []))
                if kind == 0:
                    got[0].append((at, at + len(terms)))
                    got[1].append(item)
                else:
                    got[2].append({"item_id": item, "start": at, "end": at + len(terms)})
    n = len(shard.firsts) - 1
    hits, items, spans, near = [0] * n, [[]] * n, [[]] * n, [[]] * n
    for d, (places, names, close_by) in docs.items():
        runs = merged(*np.array(places).T) if places else []
        hits[d], spans[d] = sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in runs]
        items[d], near[d] = sorted({x for x in names if x is not None}), close_by
    ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["missing"], np.uint8).astype(bool))
    return pa.table([pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int64()), ids, pa.array(np.diff(shard.firsts)), pa.array(hits, pa.int64()), pa.array(items, FOUND_SCHEMA.field("items").type), pa.array(spans, FOUND_SCHEMA.field("spans").type), pa.array(near, FOUND_SCHEMA.field("near").type)], schema=FOUND_SCHEMA)


def search_batches(blocks, n: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(blocks.value, n)
        for b in batches:
            for i in range(b.num_rows):
                yield from search_shard(b.slice(i, 1).to_pylist()[0], queries, slack).to_batches()

    return run


def query_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The test texts, read partition by partition, in blocks of so many bytes or one text."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += 8 + len((r["text"] or "").encode())
        if size >= most:
            yield held
            held, size = [], 0
    yield held


def search(index: DataFrame, benchmark: DataFrame, n: int = 10, slack: int = 0) -> DataFrame:
    """For each document: its words, how many are hit, the items found, the hit runs of words, and proximity matches."""
    spark = index.sparkSession
    blocks = query_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    look = lambda block: index.mapInArrow(search_batches(block, n, slack), FOUND)
    if second is None:
        return look(spark.sparkContext.broadcast(first)).drop("shard", "place")
    # several blocks: every document has a row for each; a block leaves the driver and the executors before the next one
    scratch, parts = Scratch(spark, "found"), []
    for block in itertools.chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        parts.append(scratch.put(look(shared), "block"))
        shared.destroy()
    del first, second, block
    found = reduce(DataFrame.unionByName, parts)
    spans = F.flatten(F.collect_list("spans"))
    runs = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    whole = found.groupBy("shard", "place", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), runs.alias("spans"), F.flatten(F.collect_list("near")).alias("near"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return whole.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", "near")


def digest(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The columns that the query returns."""
    found = search(build(documents), benchmark, n)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of documents without a hit, with all their columns.

    Words, and so hits, depend on the text alone: the index has a hash of each text in place of an id, and the rows whose
    text has the hash of a hit go, whatever their ids. Null and repeated ids do not matter. Only rows that a bitmap of the
    hits' hashes does not clear meet the hits: however many these are, the other texts are not exchanged.
    """
    text_hash = F.xxhash64("text")
    marked = documents.select(text_hash.alias("doc_id"), "text")
    scratch = Scratch(documents.sparkSession, "decontaminate")
    index = f"{scratch.folder}/postings"
    hit = scratch.put(search(build(marked, index), benchmark, n).filter("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct(), "hits")
    delete(documents.sparkSession, index)
    rows = documents.select(F.struct(*documents.columns).alias("__row"), text_hash.alias("__h"))
    return among_maybe(rows, hit, lambda some: some.join(hit, F.col("__h") == F.col("__hit"), "left_anti")).select("__row.*")
