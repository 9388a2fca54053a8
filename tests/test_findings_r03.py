"""Findings of round 3: what held on small or plain inputs only."""

import json
import pathlib

import pytest

from siltstone.plans import io_queries, registry


def test_code_files_are_in_order_of_ids(spark, tmp_path):
    """F7, validate_flat: rows that come from several files, in no order."""
    for part in range(4):
        spark.range(300).filter(f"id % 4 = {3 - part}").selectExpr("299 - id doc_id", "'x' text").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    path = io_queries.code_files(spark, str(tmp_path)).removeprefix("file:")
    for part in range(3):
        (file,) = pathlib.Path(path, f"part={part}").glob("*.json")
        assert [json.loads(line)["id"] for line in file.read_text().splitlines()] == list(range(part, 300, 3))


def test_sizes_of_large_orders(spark, tmp_path):
    """F5, humanize_size: the cube of a key is no long; tenths follow the exact value."""
    keys = [0, 10, 1024, 2097151, 2097152, 9_000_000, 54_000_001, 94_906_265, -5, None, *range(8_999_000, 9_001_000)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))

    def want(k):
        if k is None:
            return None
        n = float(k**3)
        at = next((i for i in range(4) if n < 1024 ** (i + 1)), 4)
        return f"{n / 1024**at:.1f} {('B', 'KB', 'MB', 'GB', 'TB')[at]}"

    got = {r["id"]: r["size"] for r in registry.humanize_size(spark, str(tmp_path)).collect()}
    assert got == {k: want(k) for k in keys}
    values = [0.0, 1023.0, 1024.0, 1280.0, 1048575.0, 1048576.0, -1280.0, -5.0 * 1024, 2.5 * 1024, 660000000.05 * 1024**4, 1e31, 5e17 * 1024**4, *(1.0 * i for i in range(1, 3000, 64))]
    df = spark.createDataFrame([(v,) for v in values], "n double")
    from pyspark.sql import functions as F

    from siltstone.functions import text

    for r in df.select("n", text.humanized(F.col("n")).alias("size")).collect():
        at = next((i for i in range(4) if r["n"] < 1024 ** (i + 1)), 4)
        assert r["size"] == f"{r['n'] / 1024**at:.1f} {('B', 'KB', 'MB', 'GB', 'TB')[at]}"


def test_seed_numbers_without_empty_texts(spark, tmp_path):
    """F6, seed_numbering: the SQL numbers the texts that are not empty, from 0 on."""
    spark.createDataFrame([(1, "b"), (2, ""), (3, None), (4, "a"), (5, "b"), (6, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r["id"], r["seed"]) for r in registry.seed_numbering(spark, str(tmp_path)).collect()) == [(0, " "), (1, "a"), (2, "b")]


def test_numbering_samples_few_whole_keys(spark, monkeypatch):
    """F11, seed_gather: the sample of a range exchange, which the driver gets, holds whole texts."""
    from siltstone.sources import files

    key, seen, write = "spark.sql.execution.rangeExchange.sampleSizePerPartition", [], files.written
    monkeypatch.setattr(files, "written", lambda *a: seen.append(int(spark.conf.get(key))) or write(*a))
    before = spark.conf.get(key)
    rows = files.numbered(spark.range(5000).selectExpr("concat(md5(string(id)), repeat('x', 999)) k"), "k").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["ordinal"])] == sorted(r["k"] for r in rows) and {r["ordinal"] for r in rows} == set(range(5000))
    assert seen == [files.SAMPLED] and files.SAMPLED <= 10 and spark.conf.get(key) == before


@pytest.mark.parametrize("n", [0, 1, 600])
def test_functions_of_rows_hold_few_objects(spark, n):
    """F9 and F10, function_name and blob_fetch: a batch's texts are not all Python objects at once."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StringType

    from siltstone.functions import udfs

    alive, most = set(), []

    class Text(str):
        def __del__(self):
            alive.discard(id(self))

    def made(a, b):
        out = Text(f"{a}{b}")
        alive.add(id(out))
        most.append(len(alive))
        return None if a is None else [out]

    a, b = pa.array([None if i % 7 == 0 else f"é{i}" for i in range(n)], pa.string()), pa.array(range(n), pa.int64())
    got = udfs.by_rows(made, ArrayType(StringType()), a, b)
    assert got.to_pylist() == [None if i % 7 == 0 else [f"é{i}{i}"] for i in range(n)] and max(most, default=0) <= 2 * udfs.ROWS


def test_scripts_of_one_file_run_in_many_tasks(spark, tmp_path):
    """F3, validate_tree: few files are few tasks, but scripts take long."""
    from siltstone.plans import runners

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"id": i, "response": "print(1)" if i % 3 else "1/0"}) + "\n" for i in range(60)))
    for most in (None, 30):
        out = runners.validate_folder(spark, str(tmp_path / "in"), str(tmp_path / f"out{most}"), "id long, response string", max_items=most)
        assert out["aggregated"].selectExpr("count(distinct _metadata.file_path)").collect()[0][0] == 2 * spark.sparkContext.defaultParallelism
        n = most or 60
        assert [r[:3] for r in out["file_stats"].select("input_file", "total_items", "valid_items").collect()] == [("a.jsonl", n, n * 2 // 3)]
