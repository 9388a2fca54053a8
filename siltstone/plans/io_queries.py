"""Queries of sources, sinks, syntax facts, generation, runners and reports: they write to a fresh folder that all machines
share and read it back."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siltstone.functions import text, udfs
from siltstone.operators import dataset, generate, models, prompts, seeds, validate
from siltstone.plans import runners
from siltstone.plans.pipeline import ARTEFACTS, Pipeline
from siltstone.plans.registry import ANSWERS, GOOD, VALID, code, prompt_sql, query, stripped
from siltstone.session import fresh, table
from siltstone.sources import blobs, connectors, files, sinks

LOADED = True
SEED = "id long, seed string"


def folder(spark) -> str:
    return fresh(spark, "io")


def ids_and_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seed"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id END AS id, CASE doc_id % 5 WHEN 0 THEN text WHEN 4 THEN 'kept' END AS seed FROM documents WHERE doc_id % 5 IN (0, 3, 4)")
def scan_tolerant(spark, sf_dir):
    line = F.expr("""CASE id % 5 WHEN 0 THEN to_json(struct(id, seed)) WHEN 1 THEN ' ' WHEN 2 THEN 'broken {' WHEN 3 THEN CAST(id AS STRING) ELSE '{"id": "x", "seed": "kept"}' END""")
    path = folder(spark)
    ids_and_seeds(spark, sf_dir).select(line).write.text(path)
    return files.json_lines(spark, path, SEED).select("id", "seed")


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 5 = 2")
def scan_skipped(spark, sf_dir):
    path = folder(spark)
    ids_and_seeds(spark, sf_dir).select(F.expr("CASE WHEN id % 5 = 2 THEN '{\"id\": ' ELSE '{}' END")).write.text(path)
    return files.skipped_lines(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT doc_id AS id, text AS seed FROM documents")
def scan_strict(spark, sf_dir):
    path = folder(spark)
    sinks.write_json_lines(ids_and_seeds(spark, sf_dir), path)
    return files.json_lines(spark, path, SEED, strict=True).select("id", "seed")


@query("SELECT 'lines' AS kind, doc_id AS id, text AS seed FROM documents UNION ALL SELECT 'table', doc_id, text FROM documents")
def table_or_lines(spark, sf_dir):
    rows, path = ids_and_seeds(spark, sf_dir), folder(spark)
    sinks.write_json_lines(rows, f"{path}/lines")
    sinks.write_table(rows, f"{path}/table")
    read = lambda kind: files.table_or_lines(spark, f"{path}/{kind}", SEED).select(F.lit(kind).alias("kind"), "id", "seed")
    return read("lines").unionByName(read("table"))


@query("SELECT count(*) AS whole_tree, 0::BIGINT AS flat, least(2, count(*)) AS first_two FROM (SELECT DISTINCT lang FROM documents)")
def discovery(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang").repartition("lang").write.partitionBy("lang").json(path)
    tree = files.files(spark, path, "*.json")
    flat = files.files(spark, path, "*.json", recursive=False)
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((tree, "whole_tree"), (flat, "flat"), (files.first_files(tree, 2), "first_two"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    return files.first_rows(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query("SELECT count(*) AS every_line, count(*) FILTER (doc_id % 3 > 0) AS filled FROM documents")
def line_counts(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "documents").select(F.expr("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'x' END")).write.text(path)
    return spark.createDataFrame([(files.count_lines(spark, path), files.count_lines(spark, path, blank=False))], "every_line long, filled long")


@F.arrow_udf(BinaryType())
def zipped(data: pa.Array) -> pa.Array:
    return udfs.by_rows(gzip.compress, BinaryType(), data)


@query("SELECT doc_id AS id, md5(coalesce(text, '')) AS content_md5 FROM documents WHERE doc_id % 7 > 0")
def blob_fetch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("blob_id"))
    charset = F.when(F.col("doc_id") % 3 == 0, F.lit("utf-16-le")).when(F.col("doc_id") % 3 == 1, F.lit("no such charset"))
    data = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    there = docs.filter("doc_id % 7 > 0").withColumn("data", data).select("blob_id", F.when(F.col("doc_id") % 2 == 0, zipped("data")).otherwise(F.col("data")).alias("content"))
    found = blobs.fetched(docs.select(F.col("doc_id").alias("id"), "blob_id", charset.alias("src_encoding")), there)
    return found.select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def store():
    """A client for blobs whose name says what they hold; names that end in 0 are missing."""

    def get(blob_id: str) -> bytes:
        if blob_id.endswith("0"):
            raise KeyError(blob_id)
        return f"blob {blob_id}".encode()

    return get


@query("SELECT doc_id AS id, 'blob ' || CAST(doc_id AS STRING) AS content FROM documents WHERE doc_id % 10 > 0")
def blob_client(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("blob_id"), F.lit("utf-8").alias("src_encoding"))
    return blobs.fetched_by(rows, store).select("id", "content")


@query("SELECT 'k1' AS openai, '' AS huggingface, 3 AS i, 0.5::DOUBLE AS f, '-3' AS s")
def settings(spark, sf_dir):
    env = {"OPENAI_API_KEY": "k1", "HUGGINGFACE_API_KEY": "your_key"}
    return spark.createDataFrame([(files.secret("openai", env), files.secret("huggingface", env), files.setting("3"), files.setting(".5"), files.setting("-3"))], "openai string, huggingface string, i int, f double, s string")


PARSES = "id % 13 <> 1"


@query(f"""SELECT id, md5(CASE WHEN NOT ({PARSES}) THEN '' WHEN id % 4 = 0 THEN {stripped("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}
  WHEN id % 4 = 1 THEN 'Says f.' WHEN id % 4 = 2 THEN 'short' ELSE '' END) AS docstring_md5,
  CASE WHEN {PARSES} AND id % 7 = 4 THEN 'int' ELSE '' END AS return_type,
  CASE WHEN NOT ({PARSES}) THEN '' ELSE CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'self' WHEN 5 THEN 'cls' WHEN 6 THEN 'x,y' ELSE 'x' END END AS parameters,
  {PARSES} AND id % 2 = 0 AS has_return, contains(content, '->') OR ({PARSES} AND id % 7 = 4) AS marks
  FROM (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents) JOIN code USING (id)""")
def syntax_facts(spark, sf_dir):
    c = F.col("content")
    return code(spark, sf_dir).select("id", F.md5(udfs.docstring(c).cast("binary")).alias("docstring_md5"), udfs.return_type(c).alias("return_type"), F.array_join(udfs.parameters(c), ",").alias("parameters"), udfs.returns(c).alias("has_return"), udfs.annotation_marks(c).alias("marks"))


@query("SELECT id, content FROM code")
def format_code(spark, sf_dir):
    """Without the formatter every text stays as it is."""
    return code(spark, sf_dir).select("id", udfs.formatted("content").alias("content"))


@query(f"SELECT id, content FROM code WHERE {GOOD} AND {PARSES}")
def checked_filter(spark, sf_dir):
    return seeds.filtered(code(spark, sf_dir), "compile")


@query(f"SELECT count(*) AS raw_functions, count(*) FILTER ({GOOD} AND {PARSES}) AS filtered_functions, coalesce(100.0::DOUBLE * count(*) FILTER ({GOOD} AND {PARSES}) / nullif(count(*), 0), 0) AS filter_rate FROM code")
def seed_stats_checked(spark, sf_dir):
    rows = code(spark, sf_dir)
    return seeds.seed_stats(rows, seeds.filtered(rows, "compile"))


@query("SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents")
def numbered_payload(spark, sf_dir):
    return files.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(" UNION ALL ".join(f"SELECT id, '{m}' AS mode, prompt_md5 FROM ({prompt_sql(m, examples=False)})" for m in prompts.MODES))
def prompt_zero_shot(spark, sf_dir):
    """Each mode's prompt without examples."""
    rows = code(spark, sf_dir)
    parts = [prompts.prompted(rows.withColumnRenamed("content", prompts.columns(m)[0]), m, examples=False).select("id", F.lit(m).alias("mode"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")) for m in prompts.MODES]
    return dataset.union(*parts)


@query("SELECT id, md5('<instruction>' || chr(10) || content || chr(10) || '</instruction>' || chr(10) || '<response>') AS prompt_md5 FROM code")
def prompt_inference(spark, sf_dir):
    return code(spark, sf_dir).select("id", F.md5(prompts.inference(F.col("content")).cast("binary")).alias("prompt_md5"))


class Echo:
    """Repeats the prompt, then says how long it is."""

    def generate(self, asked: list[str], seeds: list[int], **options) -> list[str]:
        return [f"{p} {len(p)} characters" for p in asked]


@query("SELECT id, CAST(length(content) + 4 AS STRING) || ' characters' AS completion FROM code")
def batched_generation(spark, sf_dir):
    rows = code(spark, sf_dir).select("id", F.concat(F.lit("ask "), F.col("content")).alias("prompt"))
    return generate.generated(rows, Echo).select("id", text.completion(F.col("prompt"), F.col("output")).alias("completion"))


@query("SELECT count(DISTINCT content) AS seeds, count(*) AS n FROM code")
def generation_seeds(spark, sf_dir):
    """A row's seed follows its prompt: as many seeds as prompts."""
    rows = code(spark, sf_dir).select(F.col("content").alias("prompt"))
    return rows.select(generate.row_seed(42).alias("seed")).agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("n"))


class Tagged:
    def generate(self, asked: list[str], seeds: list[int], **options) -> list[str]:
        return [f"{p}\nSay {options['top_k']} {options['max_length']}.</response> more" for p in asked]


@query("SELECT doc_id AS id, 'Say 50 1024.' AS response FROM documents")
def single_shot_inference(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Do "), F.col("doc_id").cast("string")).alias("instruction"))
    return models.inferred(rows, Tagged).select("id", "response")


@query("SELECT * FROM (VALUES ('8bit', 'load_in_8bit'), ('4bit', 'load_in_4bit'), ('none', '')) AS t(quantization, option)")
def quantization(spark, sf_dir):
    rows = [(q, ",".join(models.load_options(q).get("quantization_config", {}))) for q in models.QUANTIZATIONS]
    return spark.createDataFrame(rows, "quantization string, option string")


@query(f"""SELECT mode, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, sum(sample_idx) AS samples FROM (
  SELECT 'C->I' AS mode, id, s AS sample_idx FROM (SELECT * FROM code ORDER BY id LIMIT 200 OFFSET 10), (SELECT unnest([0, 1]) AS s)
  UNION ALL SELECT 'I->R', id, s * 3 + t FROM (SELECT * FROM code ORDER BY id LIMIT 200 OFFSET 10), (SELECT unnest([0, 1]) AS s), (SELECT unnest([0, 1, 2]) AS t)
  UNION ALL SELECT 'S->C', id, s FROM (SELECT * FROM code ORDER BY id LIMIT 200 OFFSET 10), (SELECT unnest([0, 1]) AS s)) GROUP BY mode""")
def generation_stages(spark, sf_dir):
    """Per-stage samples and a slice of 200 seeds from the tenth on."""
    out = generate.run_stages(code(spark, sf_dir).withColumnRenamed("content", "seed"), samples=(2, 1, 3), start=(10, 0, 0), items=(200, None, None))
    parts = [df.select(F.lit(mode).alias("mode"), "id", "sample_idx") for mode, df in out.items()]
    return dataset.union(*parts).groupBy("mode").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.sum("sample_idx").alias("samples"))


@query(f"SELECT id, concept, instruction, response FROM ({ANSWERS}) UNION ALL SELECT -1, 'old', 'old task', 'old answer'")
def generation_resumed(spark, sf_dir):
    """The first stage is skipped for a table that is there; the last goes on from earlier rows."""
    rows = code(spark, sf_dir).withColumnRenamed("content", "seed")
    concepts = generate.stage(rows, "S->C").select("id", "concept")
    old = spark.createDataFrame([(-1, "old", "old task", "old answer")], "id long, concept string, instruction string, response string")
    out = generate.run_stages(rows, continue_from=(concepts, None, old), skip=("S->C",))
    return out["I->R"].select("id", "concept", "instruction", "response")


@query("SELECT row_number() OVER (ORDER BY content) - 1 AS id, content FROM (SELECT DISTINCT text AS content FROM documents WHERE text IS NOT NULL)")
def function_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").alias("content"))
    return sinks.function_rows(seeds.distinct(rows))


@query("SELECT doc_id, text FROM documents WHERE false")
def empty_table(spark, sf_dir):
    path = folder(spark)
    sinks.write_table(table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.lit(False)), path)
    return spark.read.parquet(path)


@query("SELECT doc_id, text FROM documents")
def table_sink(spark, sf_dir):
    path = folder(spark)
    sinks.write_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS total_items, count(*) AS instruction_response_pairs FROM documents WHERE doc_id % 3 = 0")
def final_stats(spark, sf_dir):
    flag = F.when(F.col("doc_id") % 3 == 0, F.lit(True)).when(F.col("doc_id") % 3 == 1, F.lit(False))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("instruction"), F.col("source").alias("response"), flag.alias("execution_valid"))
    return dataset.final_stats(dataset.final(rows))


@query("""SELECT '{' || chr(10) || '  "total_items": ' || CAST(count(*) AS STRING) || ',' || chr(10) || '  "instruction_response_pairs": ' || CAST(count(*) AS STRING) || chr(10) || '}' AS stats
  FROM documents WHERE doc_id % 3 = 0""")
def stats_json(spark, sf_dir):
    return spark.createDataFrame([(sinks.stats_text(final_stats(spark, sf_dir)),)], "stats string")


ROWS = f"(SELECT doc_id AS id, 'file' || CAST(doc_id % 3 AS STRING) AS file, {VALID} AS valid FROM documents)"


def stand_in_rows(spark, sf_dir):
    """What a validation would say of the code rows, without running them."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr("'file' || CAST(doc_id % 3 AS STRING)").alias("file"), F.expr(VALID).alias("execution_valid"))


@query(f"""SELECT '# Run report' || chr(10) || chr(10) || '- functions: ' || CAST(raw AS STRING) || ' raw, ' || CAST(kept AS STRING) || ' kept (' || printf('%.2f', 100.0 * kept / raw) || '%)' || chr(10)
  || '- concepts: ' || CAST(raw AS STRING) || ', instructions: ' || CAST(raw AS STRING) || ', responses: ' || CAST(raw AS STRING) || chr(10)
  || '- valid: ' || CAST(valid AS STRING) || ' (' || printf('%.2f', 100.0 * valid / total) || '%)' || chr(10) || '- final pairs: ' || CAST(valid AS STRING) AS report
  FROM (SELECT count(*) AS raw, count(*) FILTER ({GOOD}) AS kept FROM code), (SELECT count(*) AS total, count(*) FILTER (valid) AS valid FROM {ROWS})""")
def run_report(spark, sf_dir):
    rows, checked = code(spark, sf_dir), stand_in_rows(spark, sf_dir)
    counts = rows.agg(*(F.count("*").alias(n) for n in ("concepts", "instructions", "responses")))
    final = dataset.final_stats(dataset.final(checked.select(F.lit("i").alias("instruction"), F.lit("r").alias("response"), "execution_valid")))
    return dataset.report(seeds.seed_stats(rows), counts, validate.stats(checked), final)


@query(f"""SELECT head || string_agg(chr(10) || chr(10) || '## ' || file || chr(10) || '- rows: ' || CAST(n AS STRING) || chr(10) || '- valid: ' || CAST(ok AS STRING), '' ORDER BY file) AS report
  FROM (SELECT file, count(*) AS n, count(*) FILTER (valid) AS ok FROM {ROWS} GROUP BY file),
  (SELECT '# Validation' || chr(10) || '- files: ' || CAST(count(DISTINCT file) AS STRING) || chr(10) || '- rows: ' || CAST(count(*) AS STRING) || chr(10) || '- valid: ' || CAST(count(*) FILTER (valid) AS STRING)
   || ' (' || printf('%.2f', 100.0 * count(*) FILTER (valid) / count(*)) || '%)' AS head FROM {ROWS}) GROUP BY head""")
def validation_report(spark, sf_dir):
    return dataset.validation_report(validate.directory_stats(stand_in_rows(spark, sf_dir), "file"))


@query("SELECT unnest([" + ", ".join(f"'{a}'" for a in ARTEFACTS) + "]) AS artefact")
def missing_artefacts(spark, sf_dir):
    """Of a run that has not begun all are missing."""
    return spark.createDataFrame([(a,) for a in Pipeline(spark, folder(spark)).missing()], "artefact string")


CODE_ROWS = "id long, response string"


def code_files(spark, sf_dir) -> str:
    """Three files of JSON lines by id, one in each folder below the root. The sort has to begin with the folder, as the writer
    else sorts by the folder alone, in place of it."""
    path = folder(spark)
    rows = code(spark, sf_dir).select("id", F.when(F.col("id") % 19 > 0, F.col("content")).alias("response"), F.expr("CAST(id % 3 AS INT)").alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "id").write.option("ignoreNullFields", "false").partitionBy("part").json(path)
    return path


@query(f"SELECT count(DISTINCT file) AS total_files, count(*) AS total_items, count(*) FILTER (valid) AS valid_items, count(*) FILTER (valid) / count(*) AS success_rate FROM {ROWS}")
def validate_tree(spark, sf_dir):
    out = runners.validate_folder(spark, code_files(spark, sf_dir), folder(spark), CODE_ROWS, glob="*.json", recursive=True)
    return out["directory_stats"].drop("file_stats")


@query(f"SELECT count(*) AS total_items, count(*) FILTER (valid) AS valid_items, count(*) FILTER (valid) / count(*) AS validation_rate FROM (SELECT * FROM {ROWS} WHERE file = 'file1' ORDER BY id LIMIT 40)")
def validate_flat(spark, sf_dir):
    """One flat folder with one file, of which the first 40 rows are taken."""
    out = runners.validate_folder(spark, code_files(spark, sf_dir) + "/part=1", folder(spark), CODE_ROWS, max_items=40, glob="*.json")
    return out["file_stats"].select("total_items", "valid_items", "validation_rate")


EXTRACTED = """(SELECT DISTINCT rtrim(regexp_replace(substr(content, instr(content, CASE id % 9 WHEN 8 THEN 'async def' ELSE 'def f' END)), '(1/0|def \\(:)\\n$', ''), chr(10)) AS content FROM code WHERE id % 4 < 2)"""


@query(f"SELECT count(*) AS raw_functions, count(*) FILTER ({GOOD}) AS filtered_functions, 100.0::DOUBLE * count(*) FILTER ({GOOD}) / count(*) AS filter_rate FROM {EXTRACTED}")
def seed_gather(spark, sf_dir):
    path = folder(spark)
    code(spark, sf_dir).select("content").write.parquet(f"{path}/source")
    return runners.gather_seeds(spark, connectors.Folder(f"{path}/source"), path, checker="compile")["stats"]


@query(f"SELECT count(*) AS pairs, 0::BIGINT AS missing FROM {EXTRACTED} WHERE {GOOD}")
def staged_pipeline(spark, sf_dir):
    """The stage runner from files to the final dataset, every stage written and read again; all its artefacts are there."""
    run = Pipeline(spark, folder(spark))
    out = run.run(code(spark, sf_dir).select("content"), checker="compile", name="code")
    return out["final"].agg(F.count("*").alias("pairs")).withColumn("missing", F.lit(len(run.missing())).cast("long"))
