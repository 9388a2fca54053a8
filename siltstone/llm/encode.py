"""Token ids of whole Arrow string columns with a tokenizer of the tokenizers library, each distinct word encoded once.

A text is cut at ASCII spaces, tabs and line ends, which the tokenizer's own pattern drops and never joins, so the
ids of a text are those of its words in order. Words of Latin letters with ASCII punctuation around them are cut
further into prefix, lower-case core and suffix, as the tokenizer's pattern cuts them, and the core goes to the BPE
model; every other word goes through the whole tokenizer. Results are kept from batch to batch up to a bound.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEEP = 200_000
#: Bytes of text whose distinct words are looked up at once: more of them share a word.
CHUNK = 4 << 20
#: ASCII punctuation without the apostrophe (contractions) as a character class.
MARKS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*"""
SIMPLE = rf"^(?P<a>{MARKS})(?P<b>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<c>{MARKS})$"


def byte_letters() -> list[str]:
    """The letter that a byte-level tokenizer writes for each byte: printable Latin-1 as it is, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of a pool one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    kind = np.int32 if max(len(pool), int(ends[-1])) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(ends[-1], dtype=kind)
    return pool[at]


class Encoder:
    """ids of texts; path: a tokenizer file whose words end at white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        # places of words, and of lower-case cores
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pieces = 0

    def add(self, words: list[str], ids: list[list[int]], core: bool) -> None:
        need = self.used + sum(map(len, ids))
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(need, len(self.pool)), np.int32)))
        if self.pieces + len(ids) > len(self.starts):
            more = np.zeros(max(len(ids), len(self.starts)), np.int64)
            self.starts, self.lengths = np.concatenate((self.starts, more)), np.concatenate((self.lengths, more))
        lengths = np.array([len(x) for x in ids], np.int64)
        ends = self.used + np.cumsum(lengths)
        self.starts[self.pieces : self.pieces + len(ids)] = ends - lengths
        self.lengths[self.pieces : self.pieces + len(ids)] = lengths
        self.pool[self.used : need] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, need - self.used)
        self.known[core].update(zip(words, range(self.pieces, self.pieces + len(ids)), strict=True))
        self.pieces, self.used = self.pieces + len(ids), need

    def places(self, words: list[str], core: bool) -> np.ndarray:
        """Where each word's ids are."""
        known = self.known[core]
        at = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(at < 0).tolist()
        if lacking:
            new = [words[i] for i in lacking]
            if core:
                letters, tokenize = self.letters, self.model.tokenize
                ids = [[t.id for t in tokenize(w if w.isascii() else "".join([letters[b] for b in w.encode()]))] for w in new]
            else:
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            at[lacking] = np.arange(self.pieces, self.pieces + len(new))
            self.add(new, ids, core)
        return at

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool with starts and lengths of the ids of distinct words."""
        if sum(map(len, self.known)) > KEEP:
            self.clear()
        parts = np.zeros((len(words), 3), np.int64)
        empty = self.places([""], False)[0]
        parts[:] = empty
        cut = pc.extract_regex(words, SIMPLE)
        simple = pc.and_(cut.is_valid(), pc.invert(pc.match_substring(words, "<|")))
        yes = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        if len(yes):
            cut = cut.filter(simple)
            for i, name in enumerate("abc"):
                field = pc.struct_field(cut, name)
                coded = (pc.utf8_lower(field) if name == "b" else field).dictionary_encode()
                parts[yes, i] = self.places(coded.dictionary.to_pylist(), name == "b")[coded.indices.to_numpy()]
        no = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        if len(no):
            parts[no, 1] = self.places(words.take(pa.array(no)).to_pylist(), False)
        flat = parts.ravel()
        lengths = self.lengths[flat]
        pool = gather(self.pool, self.starts[flat], lengths)
        lengths = lengths.reshape(-1, 3).sum(axis=1)
        return pool, np.cumsum(lengths) - lengths, lengths

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) in order, and the number of ids of each row; null is empty."""
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, counts, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
            part = texts.slice(a, b - a)
            for white in "\n\t\r":
                part = pc.replace_substring(part, white, " ")
            lists = pc.split_pattern(part, " ")
            coded = lists.flatten().dictionary_encode()
            pool, starts, lengths = self.distinct(coded.dictionary)
            codes = coded.indices.to_numpy()
            per_word = lengths[codes]
            ids.append(gather(pool, starts[codes], per_word))
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_word)))
            edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())))
            counts.append(np.diff(total[edges]))
            a = b
        return np.concatenate(ids), np.concatenate(counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
