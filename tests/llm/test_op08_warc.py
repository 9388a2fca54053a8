import base64
import hashlib
import random

import pytest

from siltstone.llm import queries, warc


def brute(pages, least=0):
    heads = {}
    for p, html in pages:
        b = (html or "").encode()
        if len(b) >= least:
            heads[b] = max(heads.get(b, p), p)
    out = []
    for p, html in pages:
        b = (html or "").encode()
        head = heads.get(b, p)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == head else "revisit", None if p == head else head))
    return sorted(out)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op8_warc_salvage(spark, sf).collect()) == brute(pages)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 700)
    pages = [(1, None), (2, ""), (3, "x"), (4, "x"), (5, "é" * 100_000), (6, "WARC/1.1\r\n\r\n"), (7, "\r\n\r\n"), (9, "x"), (8, "y")]
    df = spark.createDataFrame([(p, "http://a/\r\nX: 1" if p % 2 else None, h, "clash", 1) for p, h in pages], "page_id long, url string, html string, digest string, head int")
    pick = lambda rows: sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows if r["record_type"] != "warcinfo")
    rows = warc.round_trip(df).collect()
    assert pick(rows) == brute(pages) and not any(r["kind"] == "gap" for r in rows)
    assert {r["page_id"]: r["payload"].decode() for r in rows if r["record_type"] == "response"} == {2: "", 5: "é" * 100_000, 6: "WARC/1.1\r\n\r\n", 7: "\r\n\r\n", 8: "y", 9: "x"}
    assert pick(warc.round_trip(df, 2).collect()) == brute(pages, 2)
    assert warc.round_trip(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "v", "z")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.round_trip(twice).collect() if r["record_type"] != "warcinfo") == [("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")]


PLAIN = [warc.record(i, f"http://h/{i}", random.Random(i).randbytes(50 + 40 * i)) for i in range(6)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_finds_all_records_beside_damage(packed):
    units = [warc.member(r) for r in PLAIN] if packed else PLAIN
    rng = random.Random(packed)
    for _ in range(150):
        hurt = rng.randrange(6)
        bad = bytearray(units[hurt])
        how = rng.randrange(3)
        if how == 0:
            bad = bad[: rng.randrange(len(bad))]
        elif how == 1:
            for _ in range(3):
                bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        else:
            bad = bytearray(rng.randbytes(rng.randrange(1, 90)))
        data = b"".join([*units[:hurt], bytes(bad), *units[hurt + 1 :]])
        rows = list(warc.salvage(data))
        ids = [r["page_id"] for r in rows if r["kind"] == "record" and r["page_id"] is not None]
        assert set(range(6)) - {hurt} <= set(ids)
        for r in rows:
            if r["kind"] == "record" and r["page_id"] in range(6) and r["page_id"] != hurt:
                assert r["payload"] == random.Random(r["page_id"]).randbytes(50 + 40 * r["page_id"])
        # records and gaps cover the file without holes
        at = 0
        for r in rows:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(data)


def test_salvage_inside_members():
    """Many records in one member: one damaged, a member cut short, a broken trailer; all others come back."""
    want = lambda rows: [r["page_id"] for r in rows if r["kind"] == "record"]
    hurt = PLAIN[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    rows = list(warc.salvage(warc.member(b"".join([*PLAIN[:2], hurt, *PLAIN[3:]])) + warc.member(PLAIN[0])))
    assert want(rows) == [0, 1, 3, 4, 5, 0]
    (gap,) = [r for r in rows if r["kind"] == "gap"]
    assert (gap["offset"], gap["inner"], gap["length"]) == (0, len(PLAIN[0]) + len(PLAIN[1]), len(hurt))
    for level in (0, 6):
        whole = warc.member(b"".join(PLAIN), level)
        rows = list(warc.salvage(whole[:-20] + warc.member(PLAIN[3])))
        assert want(rows) in ([0, 1, 2, 3, 4, 3], [0, 1, 2, 3, 4, 5, 3]) and rows[-2]["kind"] == "gap"
        assert rows[-2]["offset"] + rows[-2]["length"] == len(whole) - 20 == rows[-1]["offset"]
        rows = list(warc.salvage(whole[:-5] + bytes([whole[-5] ^ 1]) + whole[-4:] + warc.member(PLAIN[3])))
        assert want(rows) == [0, 1, 2, 3, 4, 5, 3]


def test_search_is_linear():
    """Very many false starts of one kind, none of the other."""
    import time

    began = time.time()
    rows = list(warc.salvage(b"WARC/1.x" * 200_000 + PLAIN[1]))
    assert [r["kind"] for r in rows] == ["gap", "record"] and time.time() - began < 20


def test_gap_has_place_and_reason():
    data = PLAIN[0] + b"junk" + warc.member(PLAIN[1]) + PLAIN[2][:-10]
    kinds = [(r["kind"], r.get("reason")) for r in warc.salvage(data)]
    assert kinds == [("record", None), ("gap", "version line"), ("record", None), ("gap", "length")]
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("packed", [True, False])
def test_long_headers_are_read(packed):
    url = "http://h/" + "é" * 200_000
    units = [warc.record(1, url, b"x"), warc.record(2, "u", b"x", 1, True), warc.record(3, url[:-1], b"y")]
    rows = list(warc.salvage(b"".join(map(warc.member, units) if packed else units)))
    assert [(r["kind"], r["page_id"], r["url"]) for r in rows] == [("record", 1, url), ("record", 2, "u"), ("record", 3, url[:-1])]
    # headers with a line that is none are a gap, and what follows is found
    rows = list(warc.salvage(units[0][:150_000] + b"\r\njunk\r\n" + units[1]))
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("gap", None), ("record", 2)]


def test_long_urls_round_trip(spark):
    url = "http://h/" + "a" * 200_000
    df = spark.createDataFrame([(1, url, "x"), (2, "u", "x"), (3, url + "b", "x"), (4, url, "y")], "page_id long, url string, html string")
    rows = warc.round_trip(df).filter("kind = 'gap' or record_type <> 'warcinfo'").collect()
    assert sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in rows) == [(1, url, "revisit", 3), (2, "u", "revisit", 3), (3, url + "b", "response", None), (4, url, "response", None)]
