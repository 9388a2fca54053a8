import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import encode, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENC = encode.Encoder(PATH)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aBÉß'.,!?-_<|>09 \t\n\r\x0b\x1c\x85\xa0 ́İΣς漢", max_size=40), st.none()), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    ids, counts = ENC.column(pa.array(texts, pa.string()))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)] == [whole(t) for t in texts]


def test_ids_of_fixed_cases(monkeypatch):
    monkeypatch.setattr(encode, "KEEP", 3)
    monkeypatch.setattr(encode, "CHUNK", 50)
    enc = encode.Encoder(PATH)
    for texts in (["It's 'LL don't", "<|endoftext|> x<|startoftext|>.", "ÀÿßÖ, (Über)!", "a.b c-d e_f", "x" * 5000, "é ́a", "Don't,stop''s"], ["new words after clearing", ""], []):
        ids, counts = enc.column(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in whole(t)] and counts.tolist() == [len(whole(t)) for t in texts]


def slow_cuts(at, penalty, window):
    f = [0.0]
    for j in range(1, len(at)):
        f.append(min(f[i] + penalty[j] + (0 if (n := at[j] - at[i]).bit_count() == 1 else window - n) for i in range(j) if at[j] - at[i] <= window))
    return f[-1]


def test_least_cost():
    rng = random.Random(4)
    for _ in range(150):
        at, window = [0], 32
        while len(at) < 40:
            at.append(at[-1] + rng.randrange(1, 20))
        penalty = [0.0, *(rng.choice([0.0, 2.0, 9.0]) for _ in at[2:]), 0.0]
        cuts = packing.best_cuts(np.array(at), np.array(penalty), window)
        cost = sum(penalty[at.index(b)] + (0 if (b - a).bit_count() == 1 else window - b + a) for a, b in zip(cuts, cuts[1:], strict=False))
        assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= window
        assert cost == slow_cuts(at, penalty, window)


def check(rows, texts, window=2048):
    """Pieces tile documents and sequences; returns padding over ids."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids, at = [*whole(texts[d]), 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    pad = total = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        pad += 0 if at.bit_count() == 1 else window - at
    return pad / max(1, total)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(queries.op4_ordered_packing(spark, sf).collect(), texts) < 0.005


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3000)
    texts = {1: None, 2: "", 3: "a. b. c.", 4: "long " * 20_000, 5: "word. " * 900, 6: "." * 9000}
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in texts.items()], "doc_id long, text string, ids string, length int")
    rows = packing.pack(df, PATH).selectExpr("*", "crc32(ids) as ids_crc32").collect()
    check(rows, texts)
    twice = spark.createDataFrame([(7, "same"), (7, "same"), (None, "null id")], "doc_id long, text string")
    out = packing.pack(twice, PATH).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 7) == 2 * (len(whole("same")) + 1)
    assert sum(r["length"] for r in out if r["doc_id"] is None) == len(whole("null id")) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_words_are_looked_up_once_in_megabytes_of_text(monkeypatch):
    enc, asked = encode.Encoder(queries.tokenizer_path()), []
    lookup = enc.places
    monkeypatch.setattr(enc, "places", lambda words, core: asked.extend(words) or lookup(words, core))
    text = "The theory, of (Words) ab1c Ünder snake_case the of\n"
    ids, counts = enc.column(pa.array([text * 12000, None, text * 30000, text]))
    one = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [12000 * len(one), 0, 30000 * len(one), len(one)] and ids.tolist() == 42001 * one
    assert asked.count("theory") == 1


def test_packed_ids_are_freed(monkeypatch):
    """A worker serves many tasks: what one packed must not stay."""
    import tracemalloc

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["some words, of a text. " * 4000] * 40)], names=["doc_id", "text"])
    run = packing.pack_batches(PATH, 1, 2048)

    def ids():
        return sum(sum(out.column(2).to_pylist()) for out in run(iter([batch])))

    ids()
    tracemalloc.start()
    before, n = tracemalloc.get_traced_memory()[0], ids()
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert n > 900_000 and kept < n
