"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed features: neighbouring byte classes (letters, cases, digits, each common mark), word
hashes, and bins of its length and of how much of it repeats. Logarithms of the counts, times an inverse document
frequency, are projected on the leading singular vectors of at most `bound` labelled texts (those with the least hash of
their id) and scaled to unit length. These labelled vectors and the projection are broadcast: their size depends on
the bounds alone. Every text of the corpus is then held against all labelled vectors in blocks of cosine products, and
the labels of its nearest neighbours vote with a weight that falls steeply with the angle.

Defined cases: null and empty texts have no features; their score, like that of any text when there are no labels, is
the labelled texts' mean (0.5 without labels); repeated rows get equal scores; rows of `labels` with a null id or
label are passed over, and repeated ones count once with their mean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_slices, mix64
from siltstone.llm.words import SPACED, utf8, word_hashes

BOUND = 4096
DIMENSIONS = 64
NEIGHBOURS = 24
SHARPNESS = 40.0
WORD_BINS = 4096
BLOCK = 512
SLICE = 1 << 20
COMMON = b" \n\t.,;:!?-_'\"()/&%$#*+=|<>@[]{}\\"


def byte_classes() -> np.ndarray:
    """Vowels, other letters, both in capitals, digits, each common mark, other ASCII, bytes beyond ASCII."""
    out = np.full(256, 5, np.int64)
    for i, c in enumerate(COMMON):
        out[c] = 7 + i
    for c in range(256):
        if chr(c) in "aeiou":
            out[c] = 0
        elif 0x61 <= c <= 0x7A:
            out[c] = 1
        elif chr(c) in "AEIOU":
            out[c] = 2
        elif 0x41 <= c <= 0x5A:
            out[c] = 3
        elif 0x30 <= c <= 0x39:
            out[c] = 4
        elif c >= 0x80:
            out[c] = 6
    return out


CLASSES = byte_classes()
KINDS = 7 + len(COMMON)
PAIRS = KINDS * KINDS
BINS = 64
FEATURES = PAIRS + WORD_BINS + BINS


def distinct(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many different hashes each row has; a row is sorted alone, which costs much less than all rows' pairs."""
    out, a = np.zeros(len(words), np.int64), 0
    for i, n in enumerate(words.tolist()):
        if n:
            own = np.sort(hashes[a : a + n])
            out[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
        a += n
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and log counts of some texts, as a sparse matrix."""
    body, offs = utf8(texts)
    n = len(offs) - 1
    sizes = np.diff(offs)
    row = np.repeat(np.arange(n), sizes)
    kinds = CLASSES[body]
    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pair = (row[:-1] * PAIRS + kinds[:-1] * KINDS + kinds[1:])[inside]
    counts = np.bincount(pair, minlength=n * PAIRS).reshape(n, PAIRS)
    hashes, words = word_hashes(texts, SPACED)
    owner = np.repeat(np.arange(n), words)
    bins = np.bincount(owner * WORD_BINS + (hashes & np.uint64(WORD_BINS - 1)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    # length in powers of two, share of words that are new, share of words equal to the one before: each in 16 bins
    again = np.bincount(owner[1:], weights=(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), minlength=n) if len(owner) else np.zeros(n)
    fresh = distinct(hashes, words)
    some = words > 0
    shape = np.zeros((n, BINS), np.int64)
    at = np.arange(n)
    share = lambda x: np.minimum(15, (16 * x / np.maximum(1, words)).astype(np.int64))
    for base, b in ((0, np.minimum(15, np.log2(np.maximum(1, words)).astype(np.int64))), (16, share(fresh)), (32, share(again)), (48, np.minimum(15, (np.diff(offs) / np.maximum(1, words)).astype(np.int64)))):
        shape[at[some], base + b[some]] = 8 if base in (0, 48) else 60
    whole = np.concatenate((counts, bins, shape), axis=1)
    r, f = np.nonzero(whole)
    return r, f, np.log1p(whole[r, f]).astype(np.float32)


class Model:
    """idf, projection (features x dimensions), labelled unit vectors and their labels."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.projection, self.vectors, self.labels = idf, projection, vectors, labels
        self.mean = float(labels.mean()) if len(labels) else 0.5

    def latent(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        r, f, v = features(texts)
        return unit(dense(r, f, v, n, self.idf) @ self.projection)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Votes of the nearest labelled vectors, block by block."""
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        z = self.latent(texts)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(z), BLOCK):
            cos = z[a : a + BLOCK] @ self.vectors.T
            near = nearest(cos, k)
            c = np.take_along_axis(cos, near, axis=1).astype(np.float64)
            w = np.exp(SHARPNESS * (c - c.max(axis=1, keepdims=True)))
            vote = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
            some = np.abs(z[a : a + BLOCK]).sum(axis=1) > 0
            out[a : a + BLOCK][some] = vote[some]
        return np.clip(out, 0.0, 1.0)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k largest values in ascending order; of equal ones the first."""
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    take = cos >= least
    over = np.flatnonzero(take.sum(axis=1) > k)
    if len(over):
        tied = cos[over] == least[over]
        room = k - (cos[over] > least[over]).sum(axis=1, keepdims=True)
        take[over] &= ~tied | (np.cumsum(tied, axis=1) <= room)
    return np.nonzero(take)[1].reshape(-1, k)


def dense(r: np.ndarray, f: np.ndarray, v: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    x = np.zeros((n, FEATURES), np.float32)
    x[r, f] = v
    x *= idf
    return unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 0) -> Model:
    """rows: for each labelled text its features and log counts. Randomised subspace iteration over blocks of rows."""
    n = len(rows)
    df = np.zeros(FEATURES)
    for f, _ in rows:
        df[f] += 1
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, n, BLOCK):
            part = rows[a : a + BLOCK]
            r = np.repeat(np.arange(len(part)), [len(f) for f, _ in part])
            yield a, dense(r, np.concatenate([f for f, _ in part]), np.concatenate([v for _, v in part]), len(part), idf)

    rng = np.random.default_rng(seed)
    q = rng.standard_normal((FEATURES, dimensions + 16)).astype(np.float32)
    for _ in range(4 if n else 0):
        total = np.zeros_like(q)
        for _, x in blocks():
            total += x.T @ (x @ q)
        q = np.linalg.qr(total)[0]
    gram = np.zeros((q.shape[1], q.shape[1]))
    for _, x in blocks():
        y = x @ q
        gram += y.T @ y
    projection = (q @ np.linalg.eigh(gram)[1][:, ::-1][:, :dimensions]).astype(np.float32)
    vectors = np.concatenate([unit(x @ projection) for _, x in blocks()]) if n else np.zeros((0, dimensions), np.float32)
    return Model(idf, projection, vectors, labels)


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for some in byte_slices(b, 1, SLICE):
            for a in range(0, some.num_rows, 256):
                part = some.slice(a, 256)
                r, f, v = features(part.column(1))
                edges = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (f.astype(np.int32), v)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["label", "f", "v"])


def learn(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """labels: doc_id and label (0 or 1). At most `bound` labelled texts are used; each has FEATURES features at most."""
    own = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").cast("double").alias("label"))
    own = own.join(documents.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # of several texts of one id that with the least hash
    texts = documents.select("doc_id", "text").join(own, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
    rows = sorted(((r["label"], np.array(r["f"], np.int32), np.array(r["v"], np.float32)) for r in texts.mapInArrow(feature_batches, "label double, f array<int>, v array<float>").toLocalIterator()), key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))
    return fit([(f, v) for _, f, v in rows], np.array([y for y, _, _ in rows]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in byte_slices(b, 1, SLICE):
                for a in range(0, some.num_rows, 256):
                    part = some.slice(a, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score reaches a threshold."""
    shared, place = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in byte_slices(b, place, SLICE):
                for a in range(0, some.num_rows, 256):
                    part = some.slice(a, 256)
                    yield part.filter(pa.array(shared.value.scores(part.column(place)) >= least))

    return documents.mapInArrow(run, documents.schema)
