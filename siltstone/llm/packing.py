"""Order-preserving packing of documents into windows of at most 2048 ids.

The ids of a partition's documents, in the order of its rows, are one stream; runs of it are packed on their own.
Cuts may lie at document ends (free), at sentence ends (a small penalty), or elsewhere (a larger one: offered where
no other place is near, and over the last window of a run). With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + min( min over i with place(j) - place(i) <= 2048 of f(i) + 2048 - (place(j) - place(i)),
                             f(i) for windows whose length is a power of two and that need no padding ).

The inner minimum of f(i) + place(i) over a sliding range comes from a monotone queue.

No row is exchanged: sequences belong to a partition, and their ids hold its number. Defined cases: null text is
empty and yields the end id alone; repeated rows and null ids are rows of their own; an empty table gives no pieces;
a text of any length is cut at runs; other columns of the input are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import binary_slices, byte_slices
from siltstone.llm.encode import encoder

WINDOW = 2048
RUN = 1 << 19
SLICE = 4 << 20
SENTENCE_PENALTY, CUT_PENALTY = 4.0, 16.0
#: At most this many ids lie between neighbouring places for a cut.
STEP = 128
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def sentence_ends(vocabulary: dict[str, int]) -> np.ndarray:
    """For each id whether its token ends a sentence: marks only, with a full stop, question or exclamation mark."""
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        word = token.removesuffix("</w>")
        out[i] = bool(word) and word != token and not any(c.isalnum() for c in word) and any(c in ".!?" for c in word)
    return out


def places(ends: np.ndarray, sentences: np.ndarray, total: int, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts, 0 and total among them, and their penalties."""
    cost = np.full(total + 1, np.inf)
    tail = max(0, total - window)
    cost[tail:] = CUT_PENALTY
    cost[sentences] = SENTENCE_PENALTY
    cost[ends] = 0
    cost[[0, total]] = 0
    at = np.flatnonzero(cost < np.inf)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        per = (gaps[wide] - 1) // step
        first = np.repeat(at[wide], per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + 1
        cost[first + nth * step] = CUT_PENALTY
        at = np.flatnonzero(cost < np.inf)
    return at, cost[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Places of the cuts with the least cost, the first and the last place among them."""
    exact: dict[int, list[int]] = {}
    for k in range(window.bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        for j in np.flatnonzero((at >= (1 << k)) & (at[i] == at - (1 << k))).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    place, cost = at.tolist(), penalty.tolist()
    f, back = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(place)):
        x = place[j]
        low = x - window
        while place[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += window - x
        for e in exact.get(j, ()):
            if f[e] < value:
                value, i = f[e], e
        value += cost[j]
        f[j], back[j] = value, i
        key = value + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return [0, *cuts[::-1]]


def pack_run(ids: np.ndarray, lengths: np.ndarray, ends_sentence: np.ndarray, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, ...]:
    """Pieces of a run of documents of these lengths: document, start in it (of the run's part), place, length, window, offset."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    sentences = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    at, penalty = places(ends, sentences, total, window, step)
    cuts = np.array(best_cuts(at, penalty, window))
    edges = np.union1d(cuts, ends)
    edges = edges[edges > 0]
    first = np.concatenate(([0], edges[:-1]))
    doc = np.searchsorted(ends, first, side="right")
    win = np.searchsorted(cuts, first, side="right") - 1
    return doc, first - (ends - lengths)[doc], first, edges - first, win, first - cuts[win]


def pack_batches(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        ends_sentence = sentence_ends(enc.tokenizer.get_vocab())
        sequence = TaskContext.get().partitionId() << 33
        names, starts, totals, parts, held = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, names, starts, totals, parts, held
            ids = np.concatenate(parts).astype("<u4")
            doc, start, place, length, win, offset = pack_run(ids, np.array([len(p) for p in parts]), ends_sentence, window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64()).take(pa.array(doc)),
                    pa.array(start + np.array(starts)[doc], pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(np.array(totals)[doc], pa.int64()),
                    pa.array(win + sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                    binary_slices(ids, 4 * np.append(place, len(ids))),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += int(win[-1]) + 1
            names, starts, totals, parts, held = [], [], [], [], 0
            pa.default_memory_pool().release_unused()

        for b in batches:
            for some in byte_slices(b, 1, SLICE):
                flat, counts = enc.column(some.column(1))
                at = 0
                for name, n in zip(some.column(0).to_pylist(), counts.tolist(), strict=True):
                    whole = np.append(flat[at : at + n], np.int32(end_id))
                    at += n
                    for s in range(0, n + 1, RUN):
                        names.append(name)
                        starts.append(s)
                        totals.append(n + 1)
                        parts.append(whole[s : s + RUN])
                        held += len(parts[-1])
                        if held >= RUN:
                            yield from flush()
        if parts:
            yield from flush()

    return run


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32)."""
    return documents.select("doc_id", "text").mapInArrow(pack_batches(tokenizer, end_id, window), SCHEMA)
