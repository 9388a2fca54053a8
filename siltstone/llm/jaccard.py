"""Exact Jaccard join on word shingles: links between documents and their connected components.

A node is a distinct shingle set; rows with equal sets share it. Sizes fall in bands so wide that linked sets lie
in one band or in neighbouring ones. For each pair of bands the hash space is cut in more parts than the
number of elements by which two linked sets can differ, so linked sets agree in some parts entirely: what they
hold there is a key. No link can be lost, and unlinked sets seldom share a key. All sets that hold nothing in a part
would share its key: a set leaves out the parts that hold at most so many elements (nothing, one, ...) if a linked
set still agrees with it in one that holds more. Parts they agree in hold equally many, so the set of the two that
leaves out more decides, and the key of such a part is one of both.

1. A partial aggregate finds the keys that two or more nodes share and names the least node of each as its leader; they
   set bits of a bitmap, and only nodes of such keys are exchanged. Each node has a bitmap of the parities of its hashed
   elements: two bitmaps differ in at most as many bits as the sets differ in elements, so bit counts bound the overlap
   from above.
2. Leaders are held against their members: sizes, then bitmaps, and only pairs that may be linked have their texts
   fetched and their sorted arrays intersected (salted: a leader's members are spread over tasks).
3. Keys with three or more nodes that are still in two or more components are compared in tiles: nodes in order
   of size, blocks of bounded weight, pairs of blocks whose sizes are compatible and that hold several components.
   Bitmaps come first and keep the nodes with a possible partner in another component. Kept nodes that share a key form
   clusters, so that a node's text is fetched once however many keys it has; clusters are cut in tiles the same way, and
   arrays are intersected, passing over pairs that are connected by now.

Links are contracted in each task (a forest has fewer links than nodes) before components are found by repeated joins
(least label, then jumps to the label's label). Nothing of the corpus goes to the driver or is broadcast but counts and
a bitmap of bounded size (beyond its 2^30 bits more nodes are exchanged, with the same result).

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; repeated rows and repeated ids are rows of their own, and a component's id is the least doc_id that is
not null in it, else null; an empty table gives an empty result; other columns of the input are not read.
A node's name has 64 bits: sets of 10^9 distinct texts share one by chance with a probability of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, batch_rows, mix64
from siltstone.llm.filters import among, among_maybe, bits_of, buckets_for, flagged
from siltstone.llm.words import shingle_sets, utf8

#: The weight of a tile: nodes, of which one of HEAVY elements or more weighs as many as it has HEAVY elements.
TILE = 512
HEAVY = 4096
SALT_ROWS = 2000
KEY_BITS = np.uint64(52)
#: One part more for every so many elements by which linked sets can differ: parts that hold nothing can be left out.
SPARE = 16
#: Links that one task contracts, and rows whose pairs are formed at once.
FOREST = 500_000
ROWS = 20_000
#: Rows, with their whole texts, that a task hands to Python at a time.
BATCH = 1000


def bands(percent: int, most: int) -> list[int]:
    """Lower ends of the size bands up to a size."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 100 // percent)))
    return ends


class Keys:
    """The keys of a set, for the threshold intersection/union >= percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.reach(1 << 16)

    def reach(self, size: int) -> None:
        self.ends = np.array(bands(self.percent, 2 * size), np.int64)

    def band(self, n: int) -> int:
        if n >= self.ends[-3]:
            self.reach(2 * n)
        return int(np.searchsorted(self.ends, n, side="right")) - 1

    def parts(self, band: int) -> int:
        """More than the elements by which two linked sets can differ whose sizes are in this band or below."""
        most = int(self.ends[band + 1]) - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        return differ + 1 + -(-differ // SPARE)

    def of(self, items: np.ndarray) -> np.ndarray:
        n = len(items)
        if not n:
            return np.zeros(0, np.int64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(items ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        out = []
        mine = self.band(n)
        for band in (mine, mine + 1):
            # the largest set of this band that can be linked with this one; by how much they can differ
            other = min(int(self.ends[band + 1]) - 1, n * 100 // self.percent)
            if other < self.ends[band]:
                continue
            p = self.parts(band)
            spare = p - 1 - (n + other) * (100 - self.percent) // (100 + self.percent)
            edges = np.searchsorted((items >> np.uint64(32)) * np.uint64(p) >> np.uint64(32), np.arange(p + 1))
            held = np.diff(edges)
            # parts that hold the fewest elements are no keys, if there are no more of them than can be spared
            part = np.flatnonzero(held >= np.searchsorted(np.cumsum(np.bincount(held)), spare, side="right"))
            tag = part.astype(np.uint64) + np.uint64(band << 40)
            out.append(mix64((sums[edges[part + 1]] - sums[edges[part]]) ^ mix64(tag)) >> (np.uint64(64) - KEY_BITS))
        return np.concatenate(out).astype(np.int64)


def node_of(items: np.ndarray) -> int:
    """A set's 64-bit name; 0 for the empty set."""
    if not len(items):
        return 0
    total = np.add.reduce(mix64(items), dtype=np.uint64) + np.uint64(len(items))
    return int(mix64(np.array([total]))[0].astype(np.int64)) or 1


def narrow_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(len(s), node_of(s), sketch(s)) for s in shingle_sets(b.column(2), k)]
            columns = [pa.array([x[i] for x in sets], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "h", "n", "node", "sketch"])

    return run


def key_batches(k: int, percent: int, bits=None):
    """Each node's keys with its size; with a bitmap only the keys whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(percent), set()
        for b in batches:
            out, nodes, sizes, held = [], [], [], 0
            for s in shingle_sets(b.column(0), k):
                node = node_of(s)
                if not node or node in seen:
                    continue
                seen.add(node)
                own = keys.of(s)
                if bits is not None:
                    own = own[among(bits.value, own)]
                out.append(own)
                nodes.append(node)
                sizes.append(len(s))
                held += len(own)
                if held > 200_000:
                    yield packed_keys(out, nodes, sizes, bits is not None)
                    out, nodes, sizes, held = [], [], [], 0
            if out:
                yield packed_keys(out, nodes, sizes, bits is not None)

    return run


def packed_keys(out: list[np.ndarray], nodes: list[int], sizes: list[int], sized: bool) -> pa.RecordBatch:
    times = [len(x) for x in out]
    columns = {"key": np.concatenate(out), "node": np.repeat(np.array(nodes, np.int64), times)}
    if sized:
        columns["size"] = np.repeat(np.array(sizes, np.int64), times)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * both >= percent * (a + b - both)


def sketch(items: np.ndarray) -> bytes:
    """The parities of hashed elements as a bitmap of a power of two bits: 64, or 0.7 to 1.4 for each element."""
    width = max(64, 1 << (max(1, 7 * len(items) // 10) - 1).bit_length())
    bits = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """A column of bitmaps; any can be folded to a smaller width, as the low bits of a hash are its place in each."""

    def __init__(self, column: pa.Array):
        body, offs = utf8(column)
        self.data, self.first, self.words = np.ascontiguousarray(body).copy().view(np.uint64), offs[:-1] // 8, np.diff(offs) // 8

    def rows(self, at: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(at), words), np.uint64)
        own = self.words[at]
        for w in np.unique(own).tolist():
            i = np.flatnonzero(own == w)
            wide = self.data[self.first[at[i]][:, None] + np.arange(w)]
            out[i] = np.bitwise_xor.reduce(wide.reshape(len(i), w // words, words), axis=1)
        return out


def may_link(a: Sketches, i: np.ndarray, na: np.ndarray, b: Sketches, j: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be linked: sets differ in as many elements as their bitmaps in bits, or more."""
    words = np.minimum(a.words[i], b.words[j])
    out = np.zeros(len(i), bool)
    for w in np.unique(words).tolist():
        same = np.flatnonzero(words == w)
        for some in np.array_split(same, 1 + len(same) * w // (1 << 20)):
            differ = np.bitwise_count(a.rows(i[some], w) ^ b.rows(j[some], w)).sum(axis=1, dtype=np.int64)
            x, y = na[some], nb[some]
            out[some] = linked(np.minimum((x + y - differ) // 2, np.minimum(x, y)), x, y, percent)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def star_batches(k: int, percent: int):
    """Rows (leader, salt, member, node, text), a leader's own row before its members: yields the links found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, None
        for b in batches:
            leaders, salts, nodes = (b.column(i).to_pylist() for i in (0, 1, 3))
            found = []
            for leader, salt, node, items in zip(leaders, salts, nodes, shingle_sets(b.column(4), k), strict=True):
                if (leader, salt) != lead:
                    lead, lead_set = (leader, salt), None
                if node == leader:
                    lead_set = items
                elif lead_set is None:
                    raise ValueError("a leader's own row must come first")
                elif linked(overlap(lead_set, items), len(lead_set), len(items), percent):
                    found.append((leader, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return run


def pair_batches(percent: int):
    """Rows (a, b, sizes, bitmaps): keeps the pairs that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
            every = np.arange(b.num_rows)
            keep = may_link(Sketches(b.column(4)), every, sizes[0], Sketches(b.column(5)), every, sizes[1], percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["leader", "node"]).filter(pa.array(keep, pa.bool_()))

    return run


class Forest:
    """Union-find over nodes: the links that connect what all links together connect."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array([self.top(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as links between each node and the least node that it is connected with here."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.link(x, y)
    yield forest.batch()


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows whose first columns agree; rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for n, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if n and held:
                yield pa.Table.from_batches(held)
                held = []
            if y > x:
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows, some ROWS rows or one group at a time, and one past the last row of each row's group."""
    held, ends, rows = [], [], 0
    for t in groups(batches, keys):
        held.append(t)
        rows += t.num_rows
        ends.append(rows)
        if rows >= ROWS:
            yield pa.concat_tables(held), np.repeat(ends, np.diff([0, *ends]))
            held, ends, rows = [], [], 0
    if held:
        yield pa.concat_tables(held), np.repeat(ends, np.diff([0, *ends]))


def sketch_tiles(percent: int):
    """Links between the nodes of each pair of tiles that have a possible partner of another component, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t, ends in chunks(batches, 3):
            nodes, comps, side, sizes = (t.column(c).to_numpy() for c in ("node", "comp", "side", "size"))
            bits, live, step = Sketches(t.column("sketch")), np.arange(len(nodes)), 1
            while len(live):
                # each row with the one so many places after it in its group
                live = live[live + step < ends[live]]
                j = live + step
                # rows come by size: where one is too large, all that follow are
                live = live[100 * sizes[live] >= percent * sizes[j]]
                j = live + step
                ask = (comps[live] != comps[j]) & ((side[live] != side[j]) | (side[live] == 2))
                i, j = live[ask], j[ask]
                near = may_link(bits, i, sizes[i], bits, j, sizes[j], percent)
                for x, y in set(zip(nodes[i[near]].tolist(), nodes[j[near]].tolist(), strict=True)):
                    forest.link(x, y)
                step += 1
        yield forest.batch()

    return run


def tile_links(sets: list[np.ndarray], comps: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets of different components until all that are linked are connected."""
    sizes, now = np.array([len(s) for s in sets]), comps.copy()
    bits = Sketches(pa.array([sketch(s) for s in sets], pa.binary()))
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(now[rest] != now[i]) & ((side[rest] != side[i]) | (side[i] == 2))]
        rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
        if not len(rest):
            continue
        mine = np.full(len(rest), i)
        for j in rest[may_link(bits, mine, sizes[mine], bits, rest, sizes[rest], percent)].tolist():
            if now[i] != now[j] and linked(overlap(sets[i], sets[j]), int(sizes[i]), int(sizes[j]), percent):
                yield i, j
                now[now == now[j]] = now[i]


def exact_tiles(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            found = list(tile_links(list(shingle_sets(t.column("text"), k)), t.column("comp").to_numpy(), t.column("side").to_numpy(), percent))
            nodes = t.column("node").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and comp (the least node of its component) of every node that has a link; links: a written table of a, b.

    Tasks of some FOREST links contract them first; one task that holds them all has the components already.
    """
    tasks = max(1, -(-links.count() // FOREST))
    links = scratch.put(links.coalesce(tasks).mapInArrow(forest_batches, "a long, b long"), "forest")
    if tasks == 1:
        return links.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    links = links.filter("a <> b")
    both = scratch.put(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("next")), "labels").select("node", F.col("next").alias("comp"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("other"))
        least = labels.join(near, "node").select("node", "comp", F.least("comp", "other").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("jumped"))
        # a label's own label, and the least label that any of its nodes has been offered
        hook = least.groupBy(F.col("comp").alias("next")).agg(F.min("next").alias("hooked"))
        new = least.join(jump, "next", "left").join(hook, "next", "left").select("node", "comp", F.least("next", "jumped", "hooked").alias("next"))
        new = scratch.put(new, "labels")
        if new.filter(F.col("next") != F.col("comp")).isEmpty():
            return labels
        labels = new.select("node", F.col("next").alias("comp"))


def texts_of(documents: DataFrame, narrow: DataFrame, nodes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """node and text of one row for each of the given nodes."""
    text_hash = F.xxhash64("text")
    ids = scratch.put(narrow.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")), "chosen")
    near = flagged(documents.select("text"), text_hash, ids.select("h"), buckets_for(ids.count())).filter("__maybe")
    # of equal texts one, before any exchange; another text of the same hash makes another node
    rows = near.groupBy(text_hash.alias("h")).agg(F.first("text").alias("text")).join(ids, "h").select("node", "text")
    return rows.mapInArrow(own_rows(k), "node long, text string")


def links_and_components(documents: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """narrow (doc_id, hash of the text, n, node) of all rows, and comp of each node that has a link; both are written."""
    with batch_rows(documents.sparkSession, BATCH):
        return found_links(documents, scratch, k, percent)


def found_links(documents: DataFrame, scratch: Scratch, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    hashed = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    narrow = scratch.put(hashed.mapInArrow(narrow_batches(k), "doc_id long, h long, n long, node long, sketch binary"), "rows")

    # keys that several nodes share, then the nodes that have them
    rows = documents.select("text").mapInArrow(key_batches(k, percent), "key long, node long")
    led = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("key", "leader")
    led = scratch.put(led, "led")
    bits = spark.sparkContext.broadcast(bits_of(led.select("key"), buckets_for(led.count())))
    rows = documents.select("text").mapInArrow(key_batches(k, percent, bits), "key long, node long, size long")
    # a node's rows from several tasks become one by key and node, so that the join may still split a frequent key
    shared = scratch.put(rows.distinct().join(led, "key"), "keys")
    bits.unpersist()
    nodes = narrow.groupBy("node").agg(F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    nodes = scratch.put(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "nodes")

    # leaders against their members: sizes, bitmaps, then texts
    star = shared.filter("node <> leader").select("leader", "node", "size").distinct()
    heads = nodes.select(F.col("node").alias("leader"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch"))
    star = star.join(heads, "leader").filter(100 * F.least("size", "lead_size") >= percent * F.greatest("size", "lead_size"))
    star = star.join(nodes.select("node", "sketch"), "node").select("leader", "node", "lead_size", "size", "lead_sketch", "sketch")
    star = scratch.put(star.mapInArrow(pair_batches(percent), "leader long, node long"), "pairs")
    wide = star.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = star.join(wide, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), "node")
    heads = wide.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("leader").alias("node"))
    texts = texts_of(documents, narrow, star.select("node").union(star.select("leader")).distinct(), k, scratch)
    pairs = members.unionByName(heads).join(texts, "node").select("leader", "salt", "member", "node", "text")
    pairs = pairs.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "node")
    links = scratch.put(pairs.mapInArrow(star_batches(k, percent), "a long, b long"), "stars")
    comps = components(links, scratch)

    # keys whose nodes are still apart, one of each set of nodes, in tiles
    put = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mark = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"mark{i}") for i in (0, 1)]
    apart = put.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum(weight()).alias("total"), *mark).filter("lo < hi and n > 2")
    apart = apart.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("key", "total")).alias("one")).select("one.*")
    sized = scratch.put(put.join(apart, "key").select("key", "total", "node", "comp", "size"), "apart")
    order = ["key", "tile", "tile2"]
    work = in_tiles(sized, percent, scratch).join(nodes.select("node", "sketch"), "node")
    work = work.select(*order, "node", "comp", "side", "size", "sketch").repartition(*order).sortWithinPartitions(*order, "size", "node")
    near = scratch.put(work.mapInArrow(sketch_tiles(percent), "a long, b long"), "near")
    scratch.drop(shared, sized)
    if near.isEmpty():
        return narrow, comps
    clusters = components(near, scratch).select("node", F.col("comp").alias("key"))
    clusters = clusters.join(nodes.select("node", "size"), "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), "size")
    clusters = scratch.put(clusters, "clusters")
    totals = clusters.groupBy("key").agg(F.sum(weight()).alias("total"))
    work = in_tiles(clusters.join(totals, "key"), percent, scratch).join(texts_of(documents, narrow, clusters.select("node"), k, scratch), "node")
    work = work.select(*order, "node", "comp", "side", "text").repartition(*order).sortWithinPartitions(*order, "node")
    more = scratch.put(work.mapInArrow(exact_tiles(k, percent), "a long, b long"), "more")
    return narrow, comps if more.isEmpty() else components(scratch.put(links.unionByName(more), "all"), scratch)


def weight():
    return 1 + F.floor(F.col("size") / HEAVY)


def in_tiles(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """key, total (its nodes' weight), node, comp, size as pairs of tiles of a key's nodes by size: those whose sizes are
    compatible and whose components are not all one, each tile with itself too.

    A key of one tile is taken as it is. For others a node's place comes from the counts of its key's sizes and, among equal
    sizes, from its hash, so that no task sorts the nodes of a key.
    """
    cols = ["key", "tile", "tile2", "node", "comp", "size", "side"]
    zero = F.lit(0).cast("long")
    small = rows.filter(F.col("total") <= TILE).withColumns({"tile": zero, "tile2": zero, "side": F.lit(2)}).select(*cols)
    large = rows.filter(F.col("total") > TILE)
    counts = large.groupBy("key", "size").agg(F.count("*").alias("n"), F.sum(weight()).alias("w"))
    before = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n")) * weight()
    ranked = large.join(counts, ["key", "size"]).withColumn("tile", F.floor(place / TILE).cast("long")).select("key", "node", "comp", "size", "tile")
    ranked = scratch.put(ranked, "ranked")
    ends = ranked.groupBy("key", "tile").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    other = ends.select("key", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    blocks = ends.join(other, "key").filter((F.col("tile2") >= F.col("tile")) & (100 * F.col("hi") >= percent * F.col("lo2")))
    blocks = blocks.filter("least(first, first2) < greatest(last, last2)").select("key", "tile", "tile2")
    left = ranked.join(blocks, ["key", "tile"]).withColumn("side", F.when(F.col("tile") == F.col("tile2"), 2).otherwise(0)).select(*cols)
    right = ranked.withColumnRenamed("tile", "tile2").join(blocks.filter("tile < tile2"), ["key", "tile2"]).withColumn("side", F.lit(1)).select(*cols)
    return small.unionByName(left).unionByName(right)


def own_rows(k: int):
    """Keeps the rows whose text makes their node: a repeated id can bring another row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array([node_of(s) == x for s, x in zip(shingle_sets(b.column(1), k), nodes, strict=True)], pa.bool_()))

    return run


def join(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    narrow, comps = links_and_components(documents, scratch, k, percent)
    rows = narrow.join(comps, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp"))
    rows = scratch.put(rows, "labelled")
    scratch.keep(rows)
    # written, so that the join may split a large component
    least = scratch.put(rows.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = rows.filter("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id (null last), then the least text hash.

    Rows with an empty set are all kept, but for repeated rows (equal id and text), of which one stays.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    narrow, comps = links_and_components(documents, scratch, k, percent)
    rows = narrow.filter("n > 0").join(comps, "node", "left").select("doc_id", "h", F.coalesce("comp", "node").alias("comp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = scratch.put(rows.groupBy("comp").agg(F.min(order).alias("best"), F.count("*").alias("rows")).filter("rows > 1"), "best")
    gone = scratch.put(rows.join(best, "comp").filter(order != F.col("best")).select(F.col("doc_id").alias("__d"), F.col("h").alias("__g")).distinct(), "gone")
    again = scratch.put(narrow.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).filter("rows > 1").select("h").distinct(), "again")
    scratch.keep(gone, again)
    kept = among_maybe(documents.withColumn("__h", F.xxhash64("text")), gone.select("__g"), lambda some: some.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left_anti"))
    if not again.isEmpty():
        kept = among_maybe(kept, again, lambda some: some.dropDuplicates(["doc_id", "__h"]))
    return kept.select(*documents.columns)
