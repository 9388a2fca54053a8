import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import coder, queries, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def agree(rows, documents, encode):
    """documents: (doc_id, text) in ascending order of doc_id, which is unique."""
    at = 0
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(documents)
    for d, text in documents:
        ids = encode(text)
        assert (by[d]["start"], by[d]["n_tokens"], by[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 49407)), min_size=70, max_size=70), min_size=0, max_size=5), st.lists(st.integers(0, 49407), min_size=1, max_size=70))
def test_blocks_round_trip(blocks, last):
    blocks = [np.array(b, np.int32) for b in [*blocks, last]]
    bodies = coder.encode(blocks, 49408)
    assert [b.tolist() for b in coder.decode(bodies, [len(b) for b in blocks], 49408)] == [b.tolist() for b in blocks]


def test_long_blocks_and_independence():
    rng = np.random.default_rng(3)
    ids = np.concatenate((np.tile(rng.integers(0, 49408, 50), 400), rng.integers(0, 65536, 9000), np.zeros(7000), np.full(3000, 65535), rng.zipf(1.3, 9000) % 65536)).astype(np.int32)
    blocks = [ids[a : a + coder.BLOCK] for a in range(0, len(ids), coder.BLOCK)]
    bodies = coder.encode(blocks, 65536)
    assert (np.concatenate(coder.decode(bodies, [len(b) for b in blocks], 65536)) == ids).all()
    assert len(bodies[0]) < 0.25 * 2 * coder.BLOCK  # repeated ids cost little
    assert all((coder.decode([bodies[i]], [len(blocks[i])], 65536)[0] == blocks[i]).all() for i in (0, 5, len(blocks) - 1))
    with pytest.raises(ValueError):
        coder.encode([np.array([49408])], 49408)


def test_large_vocabularies():
    rng = np.random.default_rng(5)
    for vocabulary in (1, 2, 65537, 200_019, 1 << 20):
        ids = np.concatenate((rng.integers(0, vocabulary, 900), rng.zipf(1.2, 900) % vocabulary, [vocabulary - 1])).astype(np.int32)
        blocks = [ids[:1000], ids[1000:]]
        got = coder.decode(coder.encode(blocks, vocabulary), [len(b) for b in blocks], vocabulary)
        assert all((a == b).all() for a, b in zip(got, blocks, strict=True))
    most = np.arange(coder.LONGEST, dtype=np.int32)  # every id is new
    assert (coder.decode(coder.encode([most], 5000), [len(most)], 5000)[0] == most).all()


def test_fewer_bits_than_a_general_coder():
    """On the ids of whole documents, block by block: at least a tenth less than zlib."""
    import pyarrow.parquet as pq

    from siltstone.llm.encode import encoder

    enc, flat = encoder(PATH), []
    for column in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").chunks:
        flat.append(enc.column(column)[0])
    ids = np.concatenate(flat).astype(np.int32)[: 60 * coder.BLOCK]
    blocks = [ids[a : a + coder.BLOCK] for a in range(0, len(ids), coder.BLOCK)]
    ours = sum(map(len, coder.encode(blocks, 49408)))
    assert ours < 0.9 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_carries():
    """Ids that keep the coder's low end near its top: long carries must not be lost."""
    rng = random.Random(1)
    for _ in range(30):
        ids = np.array([65535 if rng.random() < 0.97 else rng.randrange(65536) for _ in range(3000)], np.int32)
        assert (coder.decode(coder.encode([ids], 65536), [3000], 65536)[0] == ids).all()


def test_damage_is_found():
    ids = np.arange(9000, dtype=np.int32)
    data = bytearray(b"".join(tokenfile.dump([1, None, 3], np.array([4000, 4999, 1]), ids, 49408)))
    names, lengths, pieces = tokenfile.load(bytes(data))
    assert names == [1, None, 3] and lengths.tolist() == [4000, 4999, 1] and (np.concatenate(list(pieces)) == ids).all()
    for at in (2, 500, len(data) - 60, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(tokenfile.Damaged):
            list(tokenfile.load(bytes(bad))[2])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    agree(queries.op2_token_files(spark, sf).collect(), docs, whole())


def test_edge_cases_and_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SLICE", 3)
    docs = [(i, t) for i, t in enumerate([None, "", "a", "b " * 30_000, "", "c. D", "<|endoftext|>"])]
    df = spark.createDataFrame([(t, i, "x", 3) for i, t in docs], "text string, doc_id long, h string, place int").repartition(3)
    tokenfile.write_tokens(df, PATH, str(tmp_path / "t"), file_ids=5, partitions=3)
    assert len(list((tmp_path / "t").glob("*.tok"))) > 3
    rows = tokenfile.read_tokens(spark, str(tmp_path / "t")).selectExpr("*", "crc32(ids) ids_crc32").collect()
    agree(rows, docs, whole())
    twice = spark.createDataFrame([(None, "n"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in tokenfile.round_trip(twice, PATH).orderBy("start").collect()] == [(None, 0), (1, 2), (1, 4)]
    assert tokenfile.round_trip(df.limit(0), PATH).count() == 0


def test_counts_of_16_bits_hold_the_longest_block():
    rng = np.random.default_rng(7)
    blocks = [rng.permutation(50_000)[: coder.LONGEST], np.full(coder.LONGEST, 3), rng.integers(0, 50_000, coder.LONGEST)]
    bodies = coder.encode(blocks, 50_000)
    for got, want in zip(coder.decode(bodies, [len(b) for b in blocks], 50_000), blocks, strict=True):
        assert got.tolist() == want.tolist()
    assert 2 * coder.LONGEST + 1 <= np.iinfo(coder.GAIN.dtype).max
    assert sum(x.nbytes for x in coder.Models(8, 50_000).sums) < 8 * 10_000


def test_batches_are_equally_large():
    blocks = -(-tokenfile.FILE_IDS // coder.BLOCK) + 1  # of a full file
    assert coder.lanes_for(blocks, 50_000) == -(-blocks // 2) < coder.BATCH
    assert [coder.lanes_for(n, 50_000) for n in (1, 7, coder.BATCH)] == [1, 7, coder.BATCH] and coder.lanes_for(0, 50_000) > 0
    assert coder.lanes_for(100, 1 << 24) == 8


def test_read_ids_are_freed():
    """A worker serves many tasks: what one read must not stay."""
    import tracemalloc

    import pyarrow as pa

    ids = np.tile(np.arange(400, dtype=np.int32), 500)
    body = b"".join(tokenfile.dump(list(range(500)), np.full(500, 400), ids, 50_000))

    def read():
        batch = pa.RecordBatch.from_arrays([pa.array([body]), pa.array([7], pa.int64())], names=["content", "first"])
        return [(r["start"], len(r["ids"]), zlib.crc32(r["ids"])) for out in tokenfile.read_batches(iter([batch])) for r in out.to_pylist()]

    assert read() == [(7 + 400 * i, 1600, zlib.crc32(ids[:400].astype("<u4").tobytes())) for i in range(500)]
    tracemalloc.start()
    before, rows = tracemalloc.get_traced_memory()[0], len(read())
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert rows == 500 and kept < ids.nbytes // 2


def test_a_writer_works_step_by_step_only_where_it_must(monkeypatch):
    """Orders 1 and 2 are mixed and hashes taken for many places at once; a reader gets the same ids."""
    asked = []
    mix = coder.shares
    monkeypatch.setattr(coder, "shares", lambda *a: asked.append(a[0].shape) or mix(*a))
    rng = np.random.default_rng(11)
    blocks = [rng.zipf(1.2, n) % 50_000 for n in (700, 700, 333)]
    bodies = coder.encode(blocks, 50_000)
    assert sum(x[0] for x in asked) == 700 and len(asked) <= -(-700 // coder.ROWS) + 1
    for got, want in zip(coder.decode(bodies, [700, 700, 333], 50_000), blocks, strict=True):
        assert got.tolist() == want.tolist()
