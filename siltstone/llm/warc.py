"""WARC 1.1 archives: a writer with revisit records, and a reader that salvages what follows damage.

Writer: payloads are grouped by their SHA-1 with an aggregate of one row for each digest; of equal payloads of at least
`min_bytes` bytes the one with the largest page_id becomes a response, the others revisit it. Payloads that occur once
are not exchanged, others once for each task, and revisits as narrow rows. Each record is a gzip member of its own; a task
starts a new file after FILE_BYTES of payload, and only files that the manifest names count.

Reader: at each place it expects a gzip member or a version line. A member must inflate, its records must have a version
line, headers, the stated length and the right block and payload digests. After a failed check the reader searches for
the next place where all that holds, yields the bytes between as a gap with the reason, and goes on from there. Inside a
member it searches the inflated bytes for version lines alike; what inflates before a member breaks off is read too.

Defined cases: null html is empty; a null url has no target URI; null page_ids are smaller than all others and come back
as null; of repeated rows one is the response, and of rows that differ in their url alone that with the largest url (null
least); an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, fresh, write_file, written
from siltstone.llm.filters import buckets_for, flagged

FILE_BYTES = 32 << 20
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAME = "urn:siltstone:page:"
STEP = 1 << 16
MANIFEST = "name string, records long"
ROWS = "file string, offset long, length long, kind string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, reason string, inner long"


def sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z", told: tuple[int, str] | None = None) -> bytes:
    """One record, not compressed. told: a revisit's payload bytes and digest, in place of the payload."""
    size, digest = told or (len(payload), sha1(payload))
    block = HTTP % size + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(4, "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Bad(ValueError):
    """Why a record can't be read."""


def page_number(value: str | None) -> int | None:
    m = re.fullmatch(rf"<?{NAME}(-?\d*)>?", value or "")
    if not m:
        raise Bad("record id")
    return int(m[1]) if m[1] else None


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at a place, and where it ends. Headers of any length are read, up to a line that is none."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Bad("version line")
    fields, first = {}, at + 10
    while True:
        end = data.find(b"\r\n", first)
        if end == first:
            break
        name, colon, value = data[first : max(end, first)].partition(b":")
        if not colon:
            raise Bad("headers")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        first = end + 2
    first += 2
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        raise Bad("length")
    last = first + int(fields["content-length"])
    if data[last : last + 4] != b"\r\n\r\n":
        raise Bad("length")
    block = data[first:last]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(block)}":
        raise Bad("block digest")
    out = {"record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "page_id": None, "payload": None, "payload_bytes": None, "payload_digest": None, "refers_to": None}
    if out["record_type"] in ("response", "revisit"):
        header, blank, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", header)
        if not blank or not length:
            raise Bad("http header")
        out |= {"page_id": page_number(fields.get("warc-record-id")), "payload_bytes": int(length[1]), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
        if out["record_type"] == "revisit":
            out["refers_to"] = page_number(fields.get("warc-refers-to"))
        elif len(payload) != out["payload_bytes"] or sha1(payload) != out["payload_digest"]:
            raise Bad("payload digest")
        else:
            out["payload"] = payload
    return out, last + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What a gzip member holds, where it ends, and why it is not whole: then all that inflates before it breaks off."""
    d, plain = zlib.decompressobj(31), []
    try:
        while not d.eof and at < len(data):
            before = d.copy()
            plain.append(d.decompress(data[at : at + STEP]))
            at += STEP
    except zlib.error:
        try:
            for i in range(at, min(at + STEP, len(data))):
                plain.append(before.decompress(data[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(plain), at, "gzip member"
    if not d.eof:
        return b"".join(plain), len(data), "gzip member is cut off"
    return b"".join(plain), min(at, len(data)) - len(d.unused_data), None


def inflated_to(data: memoryview, at: int, size: int) -> int:
    """Where the first bytes of a member end that inflate to so many."""
    d, made = zlib.decompressobj(31), 0
    while at < len(data):
        before = d.copy()
        try:
            more = len(d.decompress(data[at : at + STEP]))
        except zlib.error:
            more = size
        if made + more >= size:
            while made < size:
                made += len(before.decompress(data[at : at + 1]))
                at += 1
            return at
        made += more
        at += STEP
    return len(data)


def records(plain: bytes) -> tuple[list[dict], int]:
    """The records and gaps of a member's inflated bytes up to its last good record, and where that ends."""
    rows, at, lost, why, good = [], 0, None, None, 0
    while 0 <= at < len(plain):
        try:
            one, end = parse(plain, at)
        except Bad as e:
            if lost is None:
                lost, why = at, str(e)
            at = plain.find(VERSION, at + 1)
            continue
        if lost is not None:
            rows.append({"kind": "gap", "length": at - lost, "reason": why, "inner": lost})
            lost = None
        rows.append(one | {"kind": "record", "inner": at})
        at = good = end
    return rows, good


def unit(data: memoryview, whole: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """What the member, or the plain record, at a place holds, where that ends, and why what follows is lost if it is."""
    if data[at : at + 3] != GZIP:
        try:
            one, end = parse(whole, at)
        except Bad as e:
            return [], at + 1, str(e)
        return [one | {"kind": "record"}], end, None
    plain, end, why = inflate(data, at)
    rows, good = records(plain)
    if why is None:
        if not rows:
            return [], end, "empty member" if not plain else "member without records"
        if good < len(plain):
            rows.append({"kind": "gap", "length": len(plain) - good, "reason": "records of a member", "inner": good})
        return rows, end, None
    return rows, inflated_to(data, at, good) if rows else at + 1, why


def salvage(data: bytes | memoryview) -> Iterator[dict]:
    """Records and gaps (kind gap, with offset, length and reason) in the order of the file. inner: the place among the
    inflated bytes of the member at the offset; a gap's length with it counts inflated bytes too."""
    data = memoryview(data).cast("B")
    whole = bytes(data)
    marks = {GZIP: -1, VERSION: -1}

    def start(p: int) -> int:
        """The next place from p on where a member or a version line may start; each mark is searched for once."""
        for mark, known in marks.items():
            if known < p:
                found = whole.find(mark, p)
                marks[mark] = found if found >= 0 else len(whole)
        return min(marks.values())

    at, lost, why = 0, None, None
    while at < len(whole):
        rows, end, fault = unit(data, whole, at)
        if rows and lost is not None:
            yield {"kind": "gap", "offset": lost, "length": at - lost, "reason": why}
            lost = None
        for one in rows:
            yield {"length": end - at} | one | {"offset": at}
        if fault is None:
            at = end
            continue
        if lost is None:
            lost, why = end if rows else at, fault
        at = start(end)
        if at == lost:
            lost = None
    if lost is not None:
        yield {"kind": "gap", "offset": lost, "length": len(whole) - lost, "reason": why}


def decide(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), digest (hex) and size of the payload, revisit and refers_to of each row."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    often = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    often = scratch.put(often.select(F.xxhash64("digest").alias("h")), "digests")
    told = flagged(rows, F.xxhash64("digest"), often, buckets_for(often.count()))
    one = (F.col("size") < min_bytes) | ~F.col("__maybe")
    cols = ["page_id", "url", "html", "digest", "size"]
    single = told.filter(one).select(*cols, F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))

    # equal payloads: one html for each task and digest, and the others as rows without theirs
    many = told.filter(~one)
    head = F.struct(F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    heads = scratch.put(many.groupBy("digest").agg(F.max(head).alias("head"), F.first("html").alias("html"), F.first("size").alias("size")), "heads")
    response = heads.select("head.*", "html", "digest", "size", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    others = many.groupBy("digest", "page_id", "url", "size").agg(F.count("*").alias("n")).join(heads.select("digest", "head"), "digest")
    again = F.col("n") - (F.col("page_id").eqNullSafe(F.col("head.page_id")) & F.col("url").eqNullSafe(F.col("head.url"))).cast("int")
    others = others.withColumn("again", again).filter("again > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("again"))))
    revisit = others.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", F.lit(True).alias("revisit"), F.col("head.page_id").alias("refers_to"))
    return single.unionByName(response).unionByName(revisit)


def write_batches(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, parts, held, records = 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, parts, held, records
            name = f"part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.gz"
            write_file(f"{folder}/{name}", *parts)
            row = pa.RecordBatch.from_pylist([{"name": name, "records": records}], schema=pa.schema([("name", pa.string()), ("records", pa.int64())]))
            number, parts, held, records = number + 1, [], 0, 0
            return row

        for b in batches:
            columns = [b.column(i) if i == 2 else b.column(i).to_pylist() for i in range(7)]
            for page_id, url, html, digest, size, revisit, refers_to in zip(*columns, strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                told = size, base64.b32encode(bytes.fromhex(digest)).decode()
                if not parts:
                    parts.append(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:siltstone:file>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 21\r\n\r\nsoftware: siltstone\r\n\r\n\r\n"))
                parts.append(member(record(page_id, url, payload, refers_to, revisit, told=told)))
                held += len(payload) + len(url or "") + 512
                records += 1
                if held >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest (written to folder + "-manifest")."""
    scratch = Scratch(pages.sparkSession, "warc-digests")
    manifest = written(decide(pages, scratch, min_bytes).mapInArrow(write_batches(folder, file_bytes), MANIFEST), "manifest", f"{folder}-manifest")
    scratch.keep()
    return manifest


ROW_SCHEMA = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("reason", pa.string()), ("inner", pa.int64())]
)


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            rows, held = [], 0
            for one in salvage(body.as_buffer()):
                rows.append(one | {"file": name})
                held += len(one.get("payload") or b"") + len(one.get("url") or "") + 256
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=ROW_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ROW_SCHEMA)


def read(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records and quarantined gaps of the files that a manifest names, or of all files of a folder."""
    files = spark.read.format("binaryFile").load(folder).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    if manifest is not None:
        files = files.join(manifest.select("name"), "name", "left_semi").select("content", "name")
    return files.mapInArrow(read_batches, ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to a fresh folder that all machines share and reads them back."""
    spark = pages.sparkSession
    folder = fresh(spark, "warc")
    manifest = write(pages, folder, min_bytes)
    return spark.createDataFrame([], ROWS) if manifest.isEmpty() else read(spark, folder, manifest)
