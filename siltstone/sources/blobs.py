"""Blob content: gunzip by magic number, decode by each row's own charset."""

from __future__ import annotations

import gzip
import logging
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siltstone.functions.udfs import by_rows

log = logging.getLogger(__name__)


def plain(data: bytes | None) -> bytes | None:
    """Inflated if it starts like gzip and can be; else as it is."""
    if data is None or data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return data


def text(data: bytes | None, charset: str | None) -> str | None:
    """Decoded as stated; by UTF-8 with replacement if that fails."""
    if data is None:
        return None
    data = plain(data)
    try:
        return data.decode(charset or "utf-8")
    except (UnicodeDecodeError, LookupError):
        return data.decode("utf-8", errors="replace")


@F.arrow_udf(StringType())
def decoded(data: pa.Array, charset: pa.Array) -> pa.Array:
    return by_rows(text, StringType(), data, charset)


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """blob_id (the file's name) and content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("blob_id"), "content")


#: Clients that this worker has made, by the function that makes them.
_clients: dict = {}


def fetched_by(rows: DataFrame, make: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """Rows (blob_id, src_encoding, ...) with the text that a client returns as `content`. A worker makes one client and keeps
    it for later batches and tasks; a blob that can't be fetched is logged and its row goes."""
    schema = StructType([*(f for f in rows.schema if f.name != "content"), StructField("content", StringType())])
    names = [f.name for f in schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = f"{make.__module__}.{make.__qualname__}"
        for frame in frames:
            if key not in _clients:
                _clients[key] = make()
            found = [one(_clients[key], b, c) for b, c in zip(frame["blob_id"], frame["src_encoding"], strict=True)]
            frame = frame.assign(content=pd.Series(found, index=frame.index, dtype=object))
            yield frame[frame["content"].notna()][names]

    return rows.mapInPandas(run, schema)


def one(client: Callable[[str], bytes], blob_id: str, charset: str | None) -> str | None:
    try:
        return text(client(blob_id), charset)
    except Exception as e:  # whatever a store raises: the job goes on without the blob
        log.warning("blob %s: %s", blob_id, e)
        return None


def fetched(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows (blob_id, src_encoding, ...) with their text as `content`; rows without a blob go."""
    joined = rows.join(blobs.withColumnRenamed("content", "__bytes"), "blob_id")
    return joined.withColumn("content", decoded("__bytes", "src_encoding")).drop("__bytes")
