import zlib
from collections import Counter, defaultdict

import numpy as np

from siltstone.llm import queries, shards

DOCS = "doc_id long, text string, shard string, cell int, row string"


def check(rows, n_shards, n):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n
    assert n == 0 or max(counts.get(s, 0) for s in range(n_shards)) - min(counts.get(s, 0) for s in range(n_shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_hypergeometric_shards(spark, sf).collect()
    check(rows, 16, 1000)
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}


def test_nulls_repeats_clashing_names(spark):
    rows = [(1, "a", "x", 0, "r"), (1, "a", "x", 0, "r"), (None, None, None, None, None), (2, "", "x", 0, "r"), (3, "ü" * 100_000, "", 1, "")]
    out = shards.shard_documents(spark.createDataFrame(rows, DOCS), 3, seed=5).collect()
    check(out, 3, 5)
    assert sorted(r["size"] for r in out) == [1, 1, 2, 2, 200_001]
    assert shards.shard_documents(spark.createDataFrame([], DOCS), 16).count() == 0


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    got = np.array([shards.hypergeometric(rng, 30, 70, 20) for _ in range(20000)])
    assert abs(got.mean() - 6) < 0.05 and abs(got.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    assert shards.hypergeometric(rng, 5, 0, 3) == 3 and shards.hypergeometric(rng, 0, 5, 3) == 0
    big = shards.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6)
    assert abs(big - 300_000) < 5000


def test_matrix_sums():
    m = shards.communication_matrix([(0, 10), (5, 0), (7, 33)], 4, 3)
    assert [sent[-1] for _, sent in m] == [10, 0, 33]
    sizes = np.diff(np.array([[0, *s] for _, s in m]), axis=1).sum(axis=0)
    assert sorted(sizes) == [10, 11, 11, 11]


def test_pairs_are_uniform(spark):
    """Whether two rows share a shard depends on nothing but chance: over many seeds each pair meets about equally often."""
    df = spark.range(12).repartition(3).cache()
    meet = np.zeros((12, 12))
    for seed in range(40):
        out = {r["id"]: r["shard"] for r in shards.assign(df, 3, seed=seed * 7 + 1).collect()}
        meet += np.array([[out[i] == out[j] for j in range(12)] for i in range(12)])
    off = meet[~np.eye(12, dtype=bool)]
    assert abs(off.mean() / 40 - 3 / 11) < 0.01 and off.max() < 26


def test_write_shards(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards.write_shards(df, "doc_id", str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    assert back.drop("shard", "slot").exceptAll(df).count() == 0


def test_write_shards_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "d"), (2, None)]
    shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    check(back, 4, 6)
