import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import queries, suffixes


def brute(rows, width):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        d, t = rows[i]
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            w = b[a : a + width]
            if w in seen:
                gone[a : a + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=200).map(str.encode), st.text("aab\0\xff", max_size=60).map(lambda s: s.encode("latin-1"))))
def test_suffix_array(data):
    """All suffixes once, in order as far as the depth; exact where no two agree that far."""
    a = np.frombuffer(data, np.uint8)
    for depth in (16, 104):
        order = suffixes.suffix_array(a, depth).tolist()
        assert sorted(order) == list(range(len(data)))
        cut = [data[i:] + b"" for i in order]
        assert all(x[:depth] <= y[:depth] for x, y in zip(cut, cut[1:], strict=False))
        wanted = np.array([i * 7 % 11 < 3 for i in range(len(data))], bool)
        some = suffixes.suffix_array(a, depth, wanted).tolist()
        assert len(set(some)) == len(some) and set(np.flatnonzero(wanted).tolist()) <= set(some)
        assert all(data[x : x + depth] <= data[y : y + depth] for x, y in zip(some, some[1:], strict=False))


def test_rolling_hashes_name_windows():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=3000)), np.uint8)
    for width in (5, 100):
        h = suffixes.rolling(data, width, suffixes.BASES[0])
        windows = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
        assert len(h) == len(windows) and len(set(zip(windows, h.tolist(), strict=True))) == len(set(windows)) == len(set(h.tolist()))
    assert len(suffixes.rolling(data[:3], 5, suffixes.BASES[1])) == 0


def test_frequent_anchor_in_slices():
    """Some megabytes of one anchor come out in slices of bounded size."""
    import pyarrow as pa

    body = bytes(range(32, 127)) * 3
    n = 20_000
    cols = [pa.array([5] * n), pa.array(range(n)), pa.array([0] * n), pa.array([0] * n), pa.array([0] * n, pa.int32()), pa.array([body] * n, pa.binary()), pa.array([False] * n)]
    batch = pa.RecordBatch.from_arrays(cols, names=["anchor", "doc_id", "h", "h2", "start", "body", "twice"])
    rows = 0
    for out in suffixes.repeat_batches(100, 1 << 20, 1 << 20)(iter([batch])):
        assert out.num_rows <= suffixes.SLICE_ROWS
        rows += out.num_rows
    assert rows == n * (len(body) - 99)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 100)
    assert got(queries.op5_suffix_dedup(spark, sf)) == want and sum(w[2] > 0 for w in want) > 50


@pytest.mark.parametrize("limit", [1 << 20, 500])
def test_random_and_edge_cases(spark, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", limit)
    monkeypatch.setattr(suffixes, "CHUNK", 3000)
    rng = random.Random(limit)
    word = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    shared = [word(n) for n in (99, 100, 101, 130, 400)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), word(rng.randrange(120))]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 5000), (205, "ab" * 3000), (206, "x" * 99), (207, rows[3][1]), (208, rows[3][1]), (None, rows[4][1]), (None, "last " * 60), (209, "last " * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, 1, "clash") for d, t in rows], "text string, doc_id long, h int, start string")
    assert got(queries.op5_digest(suffixes.dedup(df))) == brute(rows, 100)
    for r in suffixes.dedup(df).filter(F.size("spans") > 0).limit(5).collect():
        assert r["n_bytes"] == len(r["kept"]) + sum(s["stop"] - s["start"] for s in r["spans"])
    twice = spark.createDataFrame([(7, "y" * 40 + word(80))] * 3, "doc_id long, text string")
    assert sorted(r["n_removed"] for r in queries.op5_digest(suffixes.dedup(twice)).collect())[0] == 0
    assert suffixes.dedup(df.limit(0)).count() == 0
