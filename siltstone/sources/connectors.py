"""Where seed files come from: a connector gives rows with `content`, or with blob_id and src_encoding to fetch it by."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.blobs import fetched_by
from siltstone.sources.files import first_rows, json_lines


class Connector(Protocol):
    def load(self, spark: SparkSession) -> DataFrame: ...


class Folder:
    """A folder of Parquet files or JSON lines, in any store that Spark reads."""

    def __init__(self, path: str, schema: str = "content string", kind: str = "parquet"):
        if kind not in ("parquet", "json"):
            raise ValueError(f"unknown kind {kind}")
        self.path, self.schema, self.kind = path, schema, kind

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path) if self.kind == "parquet" else json_lines(spark, self.path, self.schema)


class Blobs:
    """Rows of another connector whose content is fetched by a client that each worker makes once."""

    def __init__(self, listing: Connector, make_client: Callable[[], Callable[[str], bytes]]):
        self.listing, self.make_client = listing, make_client

    def load(self, spark: SparkSession) -> DataFrame:
        return fetched_by(self.listing.load(spark), self.make_client)


def contents(connector: Connector, spark: SparkSession, max_samples: int | None = None) -> DataFrame:
    """The connector's rows, so many at most."""
    return first_rows(connector.load(spark), max_samples)
