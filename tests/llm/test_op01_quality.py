import zlib

import numpy as np
import pyarrow as pa

from siltstone.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_neighbour_quality(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in out]) > 0.98
    assert np.mean([p == 0 for p, y in out if y == 0]) > 0.9


def toy():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) if i % 2 else "### ".join(rng.choice(["Q", "!!", "zz"], 30)) for i in range(60)]
    return texts, [i % 2 for i in range(60)]


def test_votes_equal_brute_force():
    texts, y = toy()
    parts = [quality.features(pa.array([t])) for t in texts]
    model = quality.fit([(f, v) for _, f, v in parts], np.array(y, float), 8)
    some = pa.array([*texts[:9], "alpha ### zz", "unseen words only", ""])
    z = model.latent(some)
    for got, v in zip(model.scores(some), z, strict=True):
        cos = (z @ model.vectors.T)[[i for i, x in enumerate(z) if x is v or (x == v).all()][0]]
        near = sorted(range(len(y)), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * (cos[near].astype(float) - cos.max()))
        want = (w * np.array(y)[near]).sum() / w.sum() if np.abs(v).sum() else np.mean(y)
        assert abs(got - want) < 1e-9


def test_nearest_breaks_ties_by_place():
    rng = np.random.default_rng(2)
    cos = rng.integers(0, 4, (50, 30)).astype(np.float32)
    for k in (1, 7, 30):
        assert quality.nearest(cos, k).tolist() == [sorted(sorted(range(30), key=lambda i: -row[i])[:k]) for row in cos]


def test_learning_from_repeated_ids_is_settled(spark):
    texts, y = toy()
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t + " other words") for i, t in enumerate(texts)] + [(0, None)]
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, label int")
    models = [quality.learn(spark.createDataFrame(some, "doc_id long, text string").repartition(n), labels) for some, n in ((rows, 3), (rows[::-1], 5))]
    assert len(models[0].labels) == 60 and all((a == b).all() for a, b in ((models[0].vectors, models[1].vectors), (models[0].labels, models[1].labels)))


def test_edge_cases(spark):
    texts, y = toy()
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " \n"), (103, "### Q " * 40_000), (0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(t, d, "x", 0.5) for d, t in rows], "text string, doc_id long, label string, score double")
    labels = spark.createDataFrame([*enumerate(y), (1, 1), (None, 1), (3, None), (999, 0)], "doc_id long, label int")
    model = quality.learn(df, labels)
    assert len(model.labels) == 60
    out = quality.score(df, model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[100] == by[101] == model.mean and by[103] < 0.5 and by[None] > 0.5 and len({r["score"] for r in out if r["doc_id"] == 0}) == 1
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in by.items() if s >= 0.5}
    none = quality.learn(df, labels.limit(0))
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.limit(0), none).count() == 0


def test_distinct_words_of_each_row():
    rng = np.random.default_rng(3)
    words = np.array([0, 5, 1, 0, 300, 2, 0])
    hashes = rng.integers(0, 40, words.sum()).astype(np.uint64) << np.uint64(57)
    edges = np.cumsum(words)
    assert quality.distinct(hashes, words).tolist() == [len(set(hashes[b - n : b].tolist())) for b, n in zip(edges.tolist(), words.tolist(), strict=True)]
    assert quality.distinct(hashes[:0], words[:0]).tolist() == []
