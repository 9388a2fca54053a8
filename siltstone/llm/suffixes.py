"""Exact substring deduplication with suffix arrays built by two-stage sorting.

A byte goes if it lies in a string of `width` bytes that also starts earlier (in the order of doc_id, text hash, place).

1. Equal texts are brought together first: all but the first of them go whole (if they have `width` bytes).
2. Every width-byte window has the least hash of its 32-byte pieces as its anchor; equal windows have equal anchors.
   Neighbouring windows with one anchor form a segment. Anchors are counted with a partial aggregate (twice if a segment
   may repeat itself), those seen twice set bits of a bitmap (of at most 2^30 bits, which is broadcast), and segments whose anchor may repeat are exchanged by
   anchor with their bytes.
3. A task takes the segments of some anchors at a time and builds the suffix array of their bytes: the suffixes that are
   smaller than their successor are sorted directly, to a depth of the width; the others are induced from them, bucket
   by bucket. Adjacent suffixes with a common prefix of the width are equal windows; all but the earliest are covered.
   Only windows are sorted, and what they are induced from; the bytes that just end a segment's last windows are not.
   An anchor with more than GROUP_BYTES of segments is not held in a task: two 64-bit hashes of each of its windows go to
   an aggregate, SLICE_ROWS at a time, which finds the same repeats.
4. Covered runs are gathered by document, merged, and cut out.

Defined cases: null text is empty; a null doc_id comes after all others; of repeated rows one is the first; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, byte_slices, mix64
from siltstone.llm.filters import among, bits_of, buckets_for, flagged
from siltstone.llm.words import utf8

WIDTH = 100
PIECE = 32
CHUNK = 2 << 20
GROUP_BYTES = 24 << 20
SLICE_ROWS = 100_000
LAST = 2**63 - 1
#: Odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def sliding(x: np.ndarray, wide: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each `wide` neighbours."""
    step = 1
    while 2 * step <= wide:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (wide - step)], x[wide - step :]) if wide > step else x


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the segments of some bytes, the first and one past the last window start of each, and whether its
    anchor's piece may come twice in it, so that its own windows can be equal."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.zeros(n - PIECE + 1, np.uint64)
    for j in range(PIECE // 8):
        h += eight[8 * j : 8 * j + len(h)] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    pieces = width - PIECE + 1
    least = sliding(h, pieces, np.minimum)
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], edge))
    mark = least[first]
    # a piece is the least of some window if it equals the largest of the minima of the windows around it
    around = np.zeros(len(least) + 2 * (pieces - 1), np.uint64)
    around[pieces - 1 : pieces - 1 + len(least)] = least
    chosen = h[h == sliding(around, pieces, np.maximum)]
    again = chosen[1:][chosen[1:] == chosen[:-1]]
    twice = np.isin(mark, again) if len(again) else np.zeros(len(mark), bool)
    return mark, first, np.concatenate((edge, [len(least)])), twice


def anchor_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in byte_slices(b, 0, CHUNK):
                body, offs = utf8(some.column(0))
                found = [anchors(body[x:y], width) for x, y in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
                marks = [m for m, *_ in found] + [m[twice] for m, _, _, twice in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks).astype(np.int64))], names=["anchor"])

    return run


SEGMENT = "anchor long, doc_id long, h long, h2 long, start int, body binary, twice boolean"


def segment_batches(bits, width: int):
    """Segments whose anchor's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in byte_slices(b, 3, CHUNK):
                body, offs = utf8(some.column(3))
                rows, marks, starts, ends, places, twice = [], [], [], [], [], []
                for i, (x, y) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
                    m, first, past, own = anchors(body[x:y], width)
                    on = among(bits.value, m.astype(np.int64))
                    rows.append(np.full(int(on.sum()), i))
                    marks.append(m[on])
                    places.append(first[on])
                    starts.append(first[on] + x)
                    ends.append(past[on] - 1 + width + x)
                    twice.append(own[on])
                rows, marks, places, starts, ends, twice = map(np.concatenate, (rows, marks, places, starts, ends, twice))
                for a in range(0, len(rows), 20_000):
                    at = pa.array(rows[a : a + 20_000])
                    sizes = (ends - starts)[a : a + 20_000]
                    stops = np.concatenate(([0], np.cumsum(sizes)))
                    flat = body[np.repeat(starts[a : a + 20_000] - stops[:-1], sizes) + np.arange(stops[-1])]
                    bodies = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat)])
                    cols = [pa.array(marks[a : a + 20_000].astype(np.int64)), *(some.column(k).take(at) for k in range(3)), pa.array(places[a : a + 20_000].astype(np.int32)), bodies, pa.array(twice[a : a + 20_000])]
                    yield pa.RecordBatch.from_arrays(cols, names=["anchor", "doc_id", "h", "h2", "start", "body", "twice"])

    return run


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; data ends with 8 bytes beyond the last place."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).byteswap()


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(data)
    out = np.zeros(n, bool)
    differs = np.flatnonzero(data[1:] != data[:-1])
    at = np.searchsorted(differs, np.arange(n))
    some = at < len(differs)
    j = differs[at[some]]
    out[some] = data[j] < data[j + 1]
    return out


def rolling(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of each window of some bytes, from running sums of a polynomial."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), dtype=np.uint64)))
    return mix64((sums[width:] - sums[:-width]) * powers(pow(base, -1, 2**64), n - width + 1))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; those of up to 2^22 places are kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 1 << 22:
            _powers[base] = known
    return known[:n]


def direct_sort(at: np.ndarray, eight: np.ndarray, depth: int, whole: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes (or more), eight bytes a round; a round takes only those still tied.
    whole: a hash of the first `depth` bytes; suffixes that share it stay as they are."""
    at = at[np.argsort(eight[at], kind="stable")]
    active = np.arange(len(at))  # places in the result whose order isn't settled
    change = eight[at][1:] != eight[at][:-1]
    for d in range(8, depth, 8):
        if not len(active):
            break
        group = np.cumsum(np.concatenate(([False], change)))
        first = np.flatnonzero(np.concatenate(([True], change)))
        # a group goes on if it has a suffix that differs from its first one
        name = whole[at[active]]
        differs = name != name[first[group]]
        go = np.bincount(group, differs)[group] > 0
        active, group = active[go], group[go]
        key = eight[at[active] + d]
        order = np.lexsort((key, group))
        at[active] = at[active[order]]
        key, group = key[order], group[order]
        change = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return at


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted suffixes (all without a mask) of some bytes in order of their first `depth` bytes, by two-stage sorting; those
    from a wanted one up to the next that is smaller than its successor come along, as it is induced from them.

    Bucket by bucket of the first byte: the suffixes greater than their successor come first, induced from the successors
    in the order of the buckets before and then of the bucket itself (runs of its byte, one byte longer at each step);
    after them come those smaller than their successor, which were sorted directly.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth + 16, np.uint8)))
    small = smaller_than_next(data)
    keep = np.ones(n, bool)
    if wanted is not None:
        # wanted, or between a wanted place and the next small one (itself included)
        from_small = np.concatenate(([0], np.cumsum(small)))[:-1]  # small places before each
        some = np.flatnonzero(wanted & ~small)
        run, at = np.unique(from_small[some], return_index=True)
        begin = np.full(int(small.sum()) + 1, n)
        begin[run] = some[at]  # the first wanted place of each run up to a small one
        keep = wanted | (np.arange(n) >= begin[from_small])
    take = np.flatnonzero(small & keep)
    direct = direct_sort(take, words_at(padded), depth, rolling(padded, depth, BASES[0]))
    induce = keep & ~small
    first = data[direct].astype(np.int64)
    edges = np.searchsorted(first, np.arange(257))
    out, filled = np.empty(int(keep.sum()), np.int64), 0
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and keep[n - 1]:
        waiting[data[-1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least of all
    for c in range(256):
        begin = filled
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(level):
            out[filled : filled + len(level)] = level
            filled += len(level)
            before = level[level > 0] - 1
            level = before[(data[before] == c) & induce[before]]
        part = direct[edges[c] : edges[c + 1]]
        out[filled : filled + len(part)] = part
        filled += len(part)
        done = out[begin:filled]
        before = done[done > 0] - 1
        byte = data[before]
        up = (byte > c) & induce[before]
        before, byte = before[up], byte[up]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for some in np.split(before, cuts):
                waiting[data[some[0]]].append(some)
        waiting[c] = []
    return out


def repeats(bodies: list[bytes], rank: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment the window starts in it whose string also starts earlier. rank: of each segment's first window;
    ranks of its later windows follow it, and those of two segments never interleave unless they are one document's."""
    lengths = np.array([len(b) for b in bodies])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), lengths)
    place = np.arange(len(data)) - (ends - lengths)[owner]
    own = place + width <= lengths[owner]  # the windows; the bytes after them only end the last ones
    order = suffix_array(data, width, own)
    order = order[own[order]]
    # common prefixes of neighbours, as far as the width
    eight = words_at(np.concatenate((data, np.zeros(8, np.uint8))))
    same = np.ones(max(0, len(order) - 1), bool)
    for d in [*range(0, width - 7, 8), width - 8]:
        i = np.flatnonzero(same)
        same[i] = eight[order[i] + d] == eight[order[i + 1] + d]
    heads = np.concatenate(([0], np.flatnonzero(~same) + 1)) if len(order) else np.zeros(0, np.int64)
    seq = rank[owner[order]] + place[order]
    earliest = np.repeat(np.minimum.reduceat(seq, heads), np.diff(np.append(heads, len(seq)))) if len(seq) else seq
    late = np.sort(order[seq != earliest])
    cuts = np.searchsorted(late, ends)
    return [place[x] for x in np.split(late, cuts[:-1])]


def runs(places: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Bytes that windows at ascending places cover, neighbouring windows as one."""
    if len(places):
        cut = np.flatnonzero(np.diff(places) > 1)
        yield from zip(places[np.concatenate(([0], cut + 1))].tolist(), (places[np.append(cut, len(places) - 1)] + width).tolist(), strict=True)


FOUND = "doc_id long, h long, h2 long, start int, stop int, window long, window2 long"
FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.int64()), ("window2", pa.int64())])


def window_rows(batches: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each window of some segments with two hashes of it, for an anchor that is too frequent for a task; so many at a time."""
    for b in batches:
        body, offs = utf8(b.column(5))
        starts, counts = b.column(4).to_numpy(), np.diff(offs) - width + 1
        one, two = (rolling(body, width, base).astype(np.int64) for base in BASES)
        for x in range(0, len(counts), max(1, SLICE_ROWS // max(1, int(counts.max(initial=1))))):
            some = np.arange(x, min(len(counts), x + max(1, SLICE_ROWS // max(1, int(counts.max(initial=1))))))
            row = np.repeat(some, counts[some])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
            at, place = offs[row] + nth, starts[row] + nth
            names = [b.column(c).take(pa.array(row)) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(place.astype(np.int32)), pa.array((place + width).astype(np.int32)), pa.array(one[at]), pa.array(two[at])], schema=FOUND_SCHEMA)


def covered_rows(table: pa.Table, width: int) -> pa.RecordBatch:
    anchor = table.column("anchor").to_numpy()
    _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    table = table.filter(pa.array((counts[inverse] > 1) | table.column("twice").to_numpy()))
    if not table.num_rows:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in FOUND_SCHEMA.types], schema=FOUND_SCHEMA)
    start = table.column("start").to_numpy().astype(np.int64)
    doc = np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    h, h2 = table.column("h").to_numpy(), table.column("h2").to_numpy()
    order = np.lexsort((h2, h, doc))
    new = np.zeros(len(order), np.int64)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    found = repeats(table.column("body").to_pylist(), (rank << 32) + start, width)
    rows = [(i, int(start[i]) + a, int(start[i]) + b) for i, places in enumerate(found) for a, b in runs(places, width)]
    at = pa.array([r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.chunked_array(table.column(c)).combine_chunks().take(at) if table.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "h", "h2")), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], schema=FOUND_SCHEMA)


def repeat_batches(width: int, chunk: int, group_bytes: int):
    """Segments sorted by anchor: covered runs, and the windows of anchors that have too many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole anchors, then the start of the last one
        size = open_size = opened = 0
        last, large = None, False
        for b in batches:
            for some in byte_slices(b, 5, chunk):
                anchor = some.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), some.num_rows]
                bytes_to = np.concatenate(([0], np.cumsum(np.diff(np.frombuffer(some.column(5).buffers()[1], np.int32)[some.column(5).offset : some.column(5).offset + some.num_rows + 1]))))
                for x, y in zip(edges, edges[1:], strict=False):
                    if anchor[x] != last:
                        large, open_size = False, 0
                        if size >= chunk:
                            yield covered_rows(pa.Table.from_batches(held), width)
                            held, size = [], 0
                        opened, last = len(held), anchor[x]
                    part, n = some.slice(x, y - x), int(bytes_to[y] - bytes_to[x])
                    if large:
                        yield from window_rows([part], width)
                        continue
                    held.append(part)
                    size, open_size = size + n, open_size + n
                    if open_size > group_bytes:
                        yield from window_rows(held[opened:], width)
                        held, size, large = held[:opened], size - open_size, True
        if held:
            yield covered_rows(pa.Table.from_batches(held), width)

    return run


def frequent(windows: DataFrame) -> DataFrame:
    """Runs for the windows of frequent anchors: all but the earliest of equal ones."""
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "h", "h2", "start")
    first = windows.groupBy("window", "window2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return windows.join(first, ["window", "window2"]).filter(order != F.col("first")).select("doc_id", "h", "h2", "start", "stop")


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a document's runs and takes them out."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    for b in batches:
        for some in byte_slices(b, 1, CHUNK):
            rows = []
            for doc_id, text, found in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), some.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for r in sorted(found or (), key=lambda r: r["start"]):
                    if spans and r["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["stop"])
                    else:
                        spans.append([r["start"], r["stop"]])
                edges = [0, *(x for s in spans for x in s), len(text)]
                rows.append((doc_id, len(text), [{"start": x, "stop": y} for x, y in spans], b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, as half-open runs) and kept (the other bytes) of every row."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce("text", F.lit(""))
    base = documents.select("doc_id", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text"))
    key = ["doc_id", "h", "h2"]

    # equal texts
    n = F.octet_length("text").cast("long")
    rows = base.groupBy(*key).agg(F.count("*").alias("rows"), F.first(n).alias("n"), F.first(F.when(n < width, F.col("text"))).alias("short"))
    rows = scratch.put(rows, "rows")
    order = F.coalesce("doc_id", F.lit(LAST))
    groups = rows.groupBy("h", "h2").agg(F.sum("rows").alias("copies"), F.min(order).alias("head")).filter("copies > 1")
    told = scratch.put(rows.join(groups, ["h", "h2"]).withColumn("is_head", order == F.col("head")), "copies")
    seen = flagged(base, F.col("h"), told.select("h").distinct(), buckets_for(told.count()))
    heads = told.filter("is_head").select(F.col("doc_id").alias("d"), F.lit(True).alias("told"), "h", "h2")
    many = seen.filter("__maybe").drop("__maybe")
    # one text of each task is exchanged, however many copies there are
    one = many.groupBy("h", "h2").agg(F.first("text").alias("text"), F.first("doc_id").alias("own"))
    single = one.join(heads, ["h", "h2"], "left").select(F.when(F.col("told"), F.col("d")).otherwise(F.col("own")).alias("doc_id"), "h", "h2", "text")
    single = scratch.put(single, "heads")
    texts = seen.filter("not __maybe").select(*key, "text").unionByName(single)
    whole = F.col("n") >= width
    kept = F.when(whole, F.lit("")).otherwise(F.col("short")).cast("binary")
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))).otherwise(F.array().cast("array<struct<start:long,stop:long>>"))
    again = F.col("rows") - F.col("is_head").cast("int")
    copies = told.withColumn("again", again).filter("again > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("again")))).select("doc_id", F.col("n").alias("n_bytes"), spans.alias("spans"), kept.alias("kept"))

    # anchors that repeat
    repeated = texts.select("text").mapInArrow(anchor_batches(width), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    repeated = scratch.put(repeated, "anchors")
    bits = spark.sparkContext.broadcast(bits_of(repeated, buckets_for(repeated.count())))
    segments = texts.mapInArrow(segment_batches(bits, width), SEGMENT)
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "h", "h2", "start")
    found = scratch.put(dealt.mapInArrow(repeat_batches(width, CHUNK, GROUP_BYTES), FOUND), "found")
    covered = found.filter("window is null").select(*key, "start", "stop").unionByName(frequent(found.filter("window is not null")))

    # cuts
    by_doc = covered.groupBy("h", "h2", order.alias("o")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    by_doc = scratch.put(by_doc, "cuts")
    bits.unpersist()
    scratch.drop(rows, repeated, found)
    told = flagged(texts, F.col("h"), by_doc.select("h"), buckets_for(by_doc.count()))
    none = told.filter("not __maybe").select("doc_id", n.alias("n_bytes"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    some = told.filter("__maybe").withColumn("o", order).join(by_doc, ["h", "h2", "o"], "left").select("doc_id", "text", "found")
    cut = some.mapInArrow(cut_batches, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return none.unionByName(cut).unionByName(copies)
