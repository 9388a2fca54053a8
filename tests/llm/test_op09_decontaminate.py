import hashlib
import random
import re

import numpy as np
import pytest

from siltstone.llm import decontaminate, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if got := windows.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    found |= got
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((str(d), len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items, 10)
    assert got(queries.op9_positional_index(spark, sf)) == want and any(w[-1] for w in want)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_random_and_edge_cases(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    rng = random.Random(block)
    text = lambda k: " ".join(rng.choice("ab Cé9,") for _ in range(rng.randrange(k)))
    docs = [*enumerate(text(60) for _ in range(80)), (80, None), (81, ""), (82, "a " * 5000 + "b"), (83, "é-É9"), (None, "a b a b a b a b"), (84, "dup a b c"), (84, "dup a b c")]
    items = [*((i, text(14)) for i in range(25)), (25, None), (26, "..."), (9, "c"), (None, "9 é c"), (27, "dup A.b")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, shard int, terms string")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    blocks = list(decontaminate.query_blocks(bench, block))
    assert (len(blocks) > 5) == (block == 1)
    monkeypatch.setattr(decontaminate, "query_blocks", lambda b: iter(blocks if block > 1 else [sum(blocks[:9], []), sum(blocks[9:], [])]))
    for n in (3, 10):
        want = brute(docs, items, n)
        assert got(decontaminate.digest(df, bench, n)) == want
    left = {r["doc_id"] for r in decontaminate.clean(df, bench, 3).collect()}
    assert left == {d for d, t in docs if not brute([(d, t)], items, 3)[0][-1]}
    assert decontaminate.clean(df, bench, 3).columns == df.columns


def test_clean_decides_by_text(spark):
    """A hit takes no other text with it: neither one with a null id too, nor one under the same id."""
    rows = [(None, "x a b c", 1), (None, "clean one", 2), (None, None, 3), (None, "clean two", 4), (7, "a b c y", 5), (7, "other words", 6), (7, "a b c y", 7), (8, "a b c y", 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(r["__h"] for r in decontaminate.clean(df, bench, 3).collect()) == [2, 3, 4, 6, 9]
    # a third of the rows have the null key; one of them is hit
    hot = spark.range(600).selectExpr("if(id % 3 = 0, null, id) doc_id", "if(id = 0, 'a b c', concat('word', id)) text")
    assert decontaminate.clean(hot, bench, 3).count() == 599


def shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_clean_exchanges_no_other_texts(spark):
    """Also where the hits are too many to be broadcast, which a threshold of nothing stands for."""
    rng = random.Random(5)
    rows = [(i, f"{rng.randbytes(2000).hex()} {'a b c' if i % 50 == 0 else i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        left = {r["doc_id"]: r["text"] for r in decontaminate.clean(df, bench, 3).collect()}
        assert left == {i: t for i, t in rows if i % 50}
        assert shuffled(spark) - before < 500_000  # of 4 MB; the 20 texts that go have 80 kB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(decontaminate.digest(df, bench.limit(0)))[0][1:4] == (2, 0, 0)
    assert decontaminate.digest(df.limit(0), bench).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x the quick old brown fox y"), (2, "the quick brown fox"), (3, "fox brown quick the"), (4, "the quick a b c d e brown fox")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the quick brown fox")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.search(decontaminate.build(df), bench, 4, slack=1).collect()}
    assert rows[1]["n_hit"] == 0 and rows[1]["near"][0]["item_id"] == 7
    assert rows[2]["n_hit"] == 4 and rows[2]["spans"][0]["start"] == 0 and not rows[2]["near"]
    assert not rows[3]["near"] and not rows[4]["near"]


def test_leb128():
    v = np.concatenate((np.arange(300), 1 << np.arange(35), [2**35 - 1, 127, 128, 0]))
    data, ends = decontaminate.leb128(v)
    assert (decontaminate.unleb128(data) == v).all() and ends[-1] == len(data)
    assert len(decontaminate.unleb128(data[:0])) == 0
