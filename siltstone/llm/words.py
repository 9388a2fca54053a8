"""Words and word shingles of Arrow string batches as 64-bit hashes, computed in numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm.common import mix64

#: Words that end at ASCII white space only.
SPACED = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
#: Words of ASCII letters, ASCII digits and everything that is not ASCII.
ALNUM = np.array([0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 19
#: What a byte adds at the first place of a word.
VALUE = LOWER.astype(np.uint64) + np.uint64(1)
_powers = {BASE: np.ones(1, dtype=np.uint64)}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        size = max(64, 1 << (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and its rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def _chunk_words(body: np.ndarray, cut: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one chunk. cut: places (beyond 0) where a word ends whatever the bytes are."""
    inside = table[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if len(cut):
        first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    # sums over the whole chunk; a word's is a difference, moved to the word's start by the inverse of the base
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(VALUE.take(body) * powers(len(body)), out=sums[1:])
    terms = (sums[ends] - sums[starts]) * powers(len(body), INVERSE)[starts]
    return starts, mix64(terms + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and the number of words of each row. Memory beyond the result is that of a chunk."""
    body, offs = utf8(column)
    starts, hashes, a = [], [], 0
    while a < len(body):
        b = min(len(body), a + CHUNK)
        while b < len(body):  # on to the next byte that can't be inside a word, or the next row
            outside = np.flatnonzero(~table[body[b : b + 65536]])
            edge = offs[np.searchsorted(offs, b)]
            near = b + int(outside[0]) if len(outside) else len(body) + 1
            if min(near, edge) <= b + 65536 or b + 65536 >= len(body):
                b = min(near, int(edge), len(body))
                break
            b += 65536
        lo, hi = np.searchsorted(offs, a, side="right"), np.searchsorted(offs, b)
        s, h = _chunk_words(body[a:b], (offs[lo:hi] - a)[offs[lo:hi] < b], table)
        starts.append(s + a)
        hashes.append(h)
        a = b
    every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(every, offs)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.diff(bounds)


def shingle_sets(column: pa.Array, k: int, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; all its words as one if it has fewer; none without words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    weights = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
        hashes, counts = word_hashes(column.slice(a, b - a), table)
        a, at = b, 0
        # the shingles that start at each word; those that reach beyond their row are not taken
        whole = np.full(max(0, len(hashes) - k + 1), k, dtype=np.uint64)
        for j in range(k):
            whole += hashes[j : j + len(whole)] * weights[j]
        whole = mix64(whole)
        for n in counts.tolist():
            if n >= k:
                items = np.sort(whole[at : at + n - k + 1])
            else:
                items = mix64(np.add.reduce(hashes[at : at + n] * weights[:n], keepdims=True) + np.uint64(n))[: min(n, 1)]
            at += n
            new = np.ones(len(items), bool)
            np.not_equal(items[1:], items[:-1], out=new[1:])
            yield items[new]
