"""Adaptive context-mixing range coder for token ids, run over many blocks at once.

A block is coded on its own: all models start anew in it. At each place three models predict:

* order 2: the id last seen after a hash of the two ids before, with a confidence,
* order 1: the id last seen after the id before, with a confidence,
* order 0: counts of all ids of the block so far, with an escape for new ones; they change after every id.

The share of the first two is learnt in each block: for every pair of confidences (and whether both name one id) it
counts how often each was right, from prior shares on. What they leave of the 2^16 units goes to order 0 by its counts,
and an escaped id is coded with equal shares for the whole vocabulary. All of it goes through one range coder with a 48-bit
low, a 32 to 48-bit range and 16-bit words.

One numpy step handles the same place of all blocks of a batch, so the cost of Python is shared by the blocks. A writer
knows all ids beforehand: only what depends on the place before is done place by place, the rest for ROWS places at once.
Ids have numbers in a block as they come, from 1 on; guesses are such numbers. Order-0 counts stand as running sums in a
tree of two levels of 64 over the numbers, after the escape, which counts one more than there were new ids.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4080
BATCH = 1024
#: Bytes of the table of leaves by id that a batch may take: larger vocabularies make smaller batches.
TABLE_BYTES = 128 << 20
SLOT_BITS = 11
SLOTS = 1 << SLOT_BITS
MOST = 7
#: Prior shares by confidence, and how many places they weigh.
TRUST2 = (0.0, 0.35, 0.55, 0.70, 0.80, 0.86, 0.90, 0.92)
TRUST1 = (0.0, 0.12, 0.28, 0.42, 0.52, 0.60, 0.66, 0.70)
PRIOR = 12
LEAST_REST = 2048
LOW32 = np.int64((1 << 32) - 1)
#: What running sums of 64 counts gain when one of them grows. A block counts at most LONGEST ids: 16 bits hold it.
GAIN = (np.arange(65)[None, :] > np.arange(64)[:, None]).astype(np.int16)
LONGEST = 4095
#: Places of all blocks for which a writer works out at once what does not depend on the place before.
ROWS = 128
#: What a slot's confidence changes by, after a miss and after a hit.
CHANGE = np.array([k // 2 - k for k in range(MOST + 1)] + [min(k + 1, MOST) - k for k in range(MOST + 1)], np.int16)


def radices(vocabulary: int) -> list[int]:
    """What an escaped id's digits are below, the highest first; a digit has at most 16 bits."""
    return [vocabulary] if vocabulary <= 1 << 16 else [(vocabulary - 1 >> 16) + 1, 1 << 16]


def hash1(ids: np.ndarray) -> np.ndarray:
    return (ids * 2654435761 >> 13) & (SLOTS - 1)


def hash2(ids: np.ndarray) -> np.ndarray:
    return (ids * 0x2545F491 >> 11) & (SLOTS - 1)


def turned(h: np.ndarray) -> np.ndarray:
    return (h << 5 | h >> (SLOT_BITS - 5)) & (SLOTS - 1)


class Models:
    """The state of the models of n blocks. A slot holds 8 * number + confidence, order 2 in the first half of the table; one
    without an id is 0, and the largest, 8 * LONGEST + 7, has 15 bits."""

    def __init__(self, n: int, vocabulary: int):
        self.n, self.vocabulary = n, vocabulary
        self.slots = np.zeros(2 * n << SLOT_BITS, np.int16)
        self.slot_base = np.arange(2 * n, dtype=np.int64).reshape(2, n) << SLOT_BITS
        # by context: of places with it, those where order 2 was right, those where order 1 was and order 2 was not, and all
        prior = np.zeros((128, 4), np.float32)
        for a in range(MOST + 1):
            for b in range(MOST + 1):
                for same in range(2):
                    two = max(TRUST2[a], TRUST1[b]) if same and a else TRUST2[a]
                    prior[same << 6 | a << 3 | b, :3] = two, 0 if same else (1 - two) * TRUST1[b], 1
        self.counts = np.tile(prior * PRIOR, (n, 1))
        self.context_base = np.arange(n, dtype=np.int64) << 7
        # order 0
        self.lanes = np.arange(n, dtype=np.int64)
        self.sums = [np.zeros((n, 65), np.int16), np.zeros((n << 6, 65), np.int16)]
        self.flat = [x.reshape(-1) for x in self.sums]

    def add(self, k: int, row: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        """Order 0 counts the numbers 64 * high + low; row: of the second level's sums."""
        self.sums[0][:k] += GAIN.take(high, axis=0, mode="clip")
        grown = self.sums[1].take(row, axis=0, mode="clip")
        grown += GAIN.take(low, axis=0, mode="clip")
        self.sums[1][row] = grown

    def learn(self, at: np.ndarray, slot: np.ndarray, trust: np.ndarray, hit: np.ndarray, number: np.ndarray) -> None:
        """A hit adds confidence, a miss halves it, and a slot with little left takes the id."""
        index = trust | hit.view(np.int8) << 3
        self.slots[at] = np.where(index <= 1, number << 3 | 1, slot + CHANGE.take(index, mode="clip"))

    def leaf_at(self, k: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number that holds a running count, the counts before it, and its own; 0 and no counts for a negative one."""
        left = left.astype(np.int16)
        leaf, before, row = 0, 0, self.lanes[:k]
        for level in range(2):
            some = self.sums[level][:k] if not level else self.sums[1].take(row, axis=0, mode="clip")
            at = np.bitwise_count(np.packbits((some[:, 1:] <= left[:, None]).reshape(-1)).view(np.uint64)).astype(np.int64)
            at = np.minimum(at, 63)
            first = self.flat[level].take(row * 65 + at, mode="clip")
            left, before = left - first, before + first
            leaf = leaf << 6 | at
            row = (self.lanes[:k] << 6) + leaf
        own = some.reshape(-1).take(self.lanes[:k] * 65 + at + 1, mode="clip") - first
        return leaf, before.astype(np.int64), own.astype(np.int64)


def shares(counts: np.ndarray, known2: np.ndarray, known1: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 2^16 units what orders 2 and 1 have, from the counts of the context; total: the counts of order 0."""
    room = 65536 - np.maximum(total, LEAST_REST)
    per = room / counts[..., 2]
    f2 = np.minimum(np.where(known2, counts[..., 0] * per, 0).astype(np.int64), room)
    return f2, np.minimum(np.where(known1, counts[..., 1] * per, 0).astype(np.int64), room - f2)


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of numbers below 2^31, which division of doubles gives exactly."""
    return (a / b).astype(np.int64)


def lanes_of(vocabulary: int) -> int:
    """Blocks that may be coded together."""
    return max(8, min(BATCH, TABLE_BYTES // (2 * vocabulary)))


def lanes_for(count: int, vocabulary: int) -> int:
    """Blocks that are coded together of so many: batches are equally large, as one of a few blocks takes as many steps."""
    most = lanes_of(vocabulary)
    return -(-count // max(1, -(-count // most))) or most


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The bytes of each block; all but the last must be equally long, none empty, of at most LONGEST ids."""
    out, step = [], lanes_for(len(blocks), vocabulary)
    for a in range(0, len(blocks), step):
        out += _encode(blocks[a : a + step], vocabulary)
    return out


def narrowed(low: np.ndarray, span: np.ndarray, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The coder's state after a part of its range, the word that leaves, and whether it does."""
    lower, wider = low + unit * start, unit * size
    full = wider <= LOW32
    return np.where(full, (lower & LOW32) << 16, lower), wider << (full.view(np.int8) * np.int64(16)), lower >> 32, full


def digits(x: np.ndarray, bases: list[int]) -> list[np.ndarray]:
    return [x] if len(bases) == 1 else [x >> 16, x & 0xFFFF]


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    n, most = len(blocks), len(blocks[0])
    if most > LONGEST:
        raise ValueError("a block is too long")
    ids = np.zeros((most, n), np.int32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    if ids.max(initial=0) >= min(vocabulary, 1 << 28) or ids.min(initial=0) < 0:
        raise ValueError("an id is beyond the vocabulary")
    m, bases = Models(n, vocabulary), radices(vocabulary)
    low, span = np.zeros(n, np.int64), np.full(n, (1 << 48) - 1, np.int64)
    # numbers of ids in their block, and whether one is new
    numbers, news, table, place = np.ones((most, n), np.int16), np.zeros((most, n), bool), np.zeros(vocabulary, np.int16), np.arange(most, dtype=np.int16)
    for i, b in enumerate(blocks):
        here = place[: len(b)]
        table[b[::-1]] = here[::-1]  # of places of one id the first stays
        first = table[b]
        news[: len(b), i] = fresh = first == here
        numbers[: len(b), i] = np.cumsum(fresh, dtype=np.int16)[first]
    used = np.ones(n, np.int64)
    # what each step of each place would send, and whether it does
    steps = 1 + len(bases)
    words, sent = np.zeros((steps * most + 3, n), np.int32), np.zeros((steps * most + 3, n), bool)
    for a in sorted({*range(0, most, ROWS), len(blocks[-1])} - {most}):
        k = n if a < len(blocks[-1]) else n - 1
        b = min(most, a // ROWS * ROWS + ROWS, len(blocks[-1]) if a < len(blocks[-1]) else most)
        wide = ids[max(0, a - 2) : b, :k].astype(np.int64)
        h1, h2 = hash1(wide), hash2(wide)
        at = np.repeat(m.slot_base[:, None, :k], b - a, axis=1)
        rows = np.arange(a, b)
        two, one = rows[rows >= 2] - max(0, a - 2), rows[rows >= 1] - max(0, a - 2)
        at[0, len(rows) - len(one) :] += h2[one - 1]
        at[0, len(rows) - len(two) :] ^= turned(h2[two - 2])
        at[1, len(rows) - len(one) :] += h1[one - 1]
        wide = wide[a - max(0, a - 2) :]
        number, new = numbers[a:b, :k].astype(np.int64), news[a:b, :k]
        high, less = number >> 6, number & 63
        row = (m.lanes[:k] << 6) + high
        at0, at1 = m.lanes[:k] * 65 + high, row * 65 + less
        trust, hit, same = np.empty(at.shape, np.int16), np.empty(at.shape, bool), np.empty(new.shape, bool)
        before, own, short = np.empty(new.shape, np.int16), np.empty(new.shape, np.int16), numbers[a:b, :k]
        for t in range(b - a):
            slot = m.slots.take(at[:, t], mode="clip")
            guess = slot >> 3
            trust[:, t], hit[:, t], same[t] = slot & MOST, guess == short[t], guess[0] == guess[1]
            m.learn(at[:, t], slot, trust[:, t], hit[:, t], short[t])
            start = m.flat[1].take(at1[t], mode="clip")
            own[t] = m.flat[1].take(at1[t] + 1, mode="clip") - start
            before[t] = start + m.flat[0].take(at0[t], mode="clip")
            m.add(k, row[t], high[t], less[t])
        known = trust > 0
        same &= known[0] & known[1]
        context = m.context_base[:k] + ((same.astype(np.int64) << 6) | (trust[0] << 3) | trust[1])
        counts, gain = np.empty((b - a, k, 4), np.float32), np.zeros((b - a, k, 4), np.float32)
        gain[..., 0], gain[..., 1], gain[..., 2] = hit[0], hit[1] & ~hit[0], 1
        for t in range(b - a):
            counts[t] = m.counts.take(context[t], axis=0, mode="clip")
            m.counts[context[t]] = counts[t] + gain[t]
        escapes = used[:k] + np.cumsum(new, axis=0) - new
        total = escapes + rows[:, None]
        f2, f1 = shares(counts, known[0], known[1] & ~same, total)
        base = f2 + f1
        rest = 65536 - base
        hit2 = hit[0] & (f2 > 0)
        hit1 = hit[1] & (f1 > 0) & ~hit2
        below, upto = np.where(new, 0, escapes + before), np.where(new, escapes, escapes + before + own)
        lo = quotient(below * rest, total)
        start = np.where(hit2, 0, np.where(hit1, f2, base + lo))
        size = np.where(hit2, f2, np.where(hit1, f1, quotient(upto * rest, total) - lo))
        used[:k] += new.sum(axis=0)
        for t in range(b - a):
            to = steps * (a + t)
            low[:k], span[:k], words[to, :k], sent[to, :k] = narrowed(low[:k], span[:k], start[t], size[t], span[:k] >> 16)
            fresh = np.flatnonzero(new[t])
            if len(fresh):
                for j, (digit, radix) in enumerate(zip(digits(wide[t, fresh], bases), bases, strict=True), 1):
                    low[fresh], span[fresh], words[to + j, fresh], sent[to + j, fresh] = narrowed(low[fresh], span[fresh], digit, np.int64(1), span[fresh] // radix)
    words[-3], words[-2], words[-1] = low >> 32, low >> 16 & 0xFFFF, low & 0xFFFF
    sent[-3:] = True
    out = []
    for i in range(n):
        w = words[:, i][sent[:, i]].astype(np.int64)
        while (carry := w >> 16).any():  # a word beyond 16 bits adds to the word before
            w &= 0xFFFF
            w[:-1] += carry[1:]
        out.append(w.astype("<u2").tobytes())
    return out


def decode(bodies: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of blocks; all but the last must be equally long, none empty."""
    out, step = [], lanes_for(len(bodies), vocabulary)
    for a in range(0, len(bodies), step):
        out += _decode(bodies[a : a + step], lengths[a : a + step], vocabulary)
    return out


def _decode(bodies: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    n, most = len(bodies), lengths[0]
    words = np.zeros((n, max(len(b) for b in bodies) // 2 + 1), np.uint16)
    for i, b in enumerate(bodies):
        words[i, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
    value = words[:, :3].astype(np.int64) @ (1 << np.array([32, 16, 0]))
    width, words = words.shape[1], words.ravel()
    at = np.arange(n) * width + 3
    m, bases = Models(n, vocabulary), radices(vocabulary)
    span = np.full(n, (1 << 48) - 1, np.int64)
    ids, names = np.zeros((most, n), np.int32), np.zeros(n << 12, np.int32)
    every = np.arange(vocabulary, dtype=np.int64)
    first, second = hash1(every), hash2(every)
    slot_at, last, used, name_base = m.slot_base.copy(), np.zeros(n, np.int64), np.ones(n, np.int64), m.lanes << 12
    del every

    def consume(i, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        lower, wider = value[i] - unit * start, unit * size
        full = wider <= LOW32
        value[i] = np.where(full, lower << 16 | words.take(at[i], mode="clip"), lower)
        at[i] += full
        span[i] = wider << (full.view(np.int8) * np.int64(16))

    for t in range(most):
        k = n if t < lengths[-1] else n - 1
        slot = m.slots.take(slot_at[:, :k], mode="clip")
        trust, guess, known = slot & MOST, slot >> 3, slot > 0
        same = (guess[0] == guess[1]) & known[0]
        context = m.context_base[:k] + (same * np.int16(64) | trust[0] << 3 | trust[1])
        counts = m.counts.take(context, axis=0, mode="clip")
        total = used[:k] + t
        f2, f1 = shares(counts, known[0], known[1] & ~same, total)
        base = f2 + f1
        rest = 65536 - base
        unit = span[:k] >> 16
        part = np.minimum(value[:k] / unit, 65535.0).astype(np.int64)
        hit2, hit = part < f2, part < base
        u = quotient((np.maximum(part - base, 0) + 1) * total - 1, rest) - used[:k]
        leaf, before, own = m.leaf_at(k, u)
        new = u < 0
        below = np.where(new, 0, used[:k] + before)
        upto = np.where(new, used[:k], below + own)
        lo = quotient(below * rest, total)
        consume(slice(0, k), np.where(hit, np.where(hit2, 0, f2), base + lo), np.where(hit, np.where(hit2, f2, f1), quotient(upto * rest, total) - lo), unit)
        number = np.where(hit, np.where(hit2, guess[0], guess[1]), leaf)
        new = np.flatnonzero(new & ~hit)
        if len(new):
            found = np.zeros(len(new), np.int64)
            for radix in bases:
                step = span[new] // radix
                digit = np.minimum(value[new] / step, radix - 1.0).astype(np.int64)
                consume(new, digit, np.int64(1), step)
                found = found << 16 | digit
            number[new] = fresh = used[new]
            # a damaged block may name any number
            names[name_base[new] + fresh] = np.minimum(found, vocabulary - 1)
            used[new] += 1
        x = ids[t, :k] = names.take(name_base[:k] + number, mode="clip")
        short = number.astype(np.int16)
        hits = guess == short
        m.learn(slot_at[:, :k], slot, trust, hits, short)
        counts[:, 0] += hits[0]
        counts[:, 1] += hits[1] > hits[0]
        counts[:, 2] += 1
        m.counts[context] = counts
        high = number >> 6
        m.add(k, (m.lanes[:k] << 6) + high, high, number & 63)
        h = second.take(x, mode="clip")
        slot_at[0, :k] = m.slot_base[0, :k] + (last[:k] ^ h)
        last[:k] = turned(h)
        slot_at[1, :k] = m.slot_base[1, :k] + first.take(x, mode="clip")
    return [np.ascontiguousarray(ids[: lengths[i], i]) for i in range(n)]
