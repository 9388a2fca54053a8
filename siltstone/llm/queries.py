"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, jpeg, oracles, packing, quality, secrets, shards, suffixes, tokenfile, warc
from siltstone.session import table


def held_out() -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(documents: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.learn(documents, labels)


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = quality.score(documents, quality_model(documents, spark, sf_dir))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The vocabulary file of the queries; it must be at the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_digest(rows: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_digest(suffixes.dedup(table(spark, sf_dir, "documents"), width=100))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jpeg.read(jpeg.store(table(spark, sf_dir, "documents")))
    payload, media, rgb = F.col("payload"), F.col("media"), F.col("rgb")
    tensor = [F.array("height", "width", F.lit(3)).alias("rgb_shape"), F.octet_length(rgb).cast("long").alias("rgb_bytes"), F.crc32(rgb).cast("long").alias("rgb_crc32")]
    tail = F.expr("crc32(substring(payload, -16, 16))").cast("long").alias("tail_crc32")
    return rows.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), tail, F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), "feature", *tensor)


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).filter("kind = 'record' and record_type <> 'warcinfo'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbour_quality, op2_token_files, op3_hypergeometric_shards, op4_ordered_packing, op5_suffix_dedup, op6_progressive_jpeg, op7_jaccard_components, op8_warc_salvage, op9_positional_index, op10_secret_spans)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
