"""Syntax functions, execution, sources, sinks, the stage runner and the stream."""

import gzip
import json

import pytest

from siltstone.functions import syntax
from siltstone.operators import dataset, seeds, validate
from siltstone.plans import io_queries, runners
from siltstone.plans.pipeline import Pipeline
from siltstone.sources import blobs, connectors, files, sinks
from siltstone.streaming.seeds import gather

DOC = 'def f(x):\n    """d"""\n    return x'


@pytest.mark.parametrize(
    ("source", "n"),
    [
        (DOC, 1), ('def f(x):\n    "d"\n    return x', 0), ('def f(x):\n    r"""d"""\n    return x', 0), ('def f(x):\n    y = x\n    """d"""\n    return y', 1),
        ('def f(x):\n    """a"""\n    def g(y):\n        """b"""\n        return y\n    return g', 2), ('class A:\n  @p\n  def f(self):\n    """d"""', 1), ("async " + DOC, 1),
        (DOC + "\n" + DOC, 1), (DOC + "\ndef (:\n", 1), ('def f(x):\n    """a""" "b"\n', 0), ("", 0), (None, 0), ("x\0y", 0), ("def f(x):\n    '''d'''\n", 1),
    ],
)
def test_functions(source, n):
    found = syntax.functions(source)
    assert len(found) == n and all(t.startswith(("def", "async def")) for t in found)


def test_metrics():
    assert syntax.complexity("if a and b and c: pass") == 4 and syntax.complexity("if a or b: pass") == 2 and syntax.complexity("def (:") == 100
    assert syntax.main_name("async def f(x: int) -> int: pass") is None and not syntax.annotated("async def f(x: int) -> int: pass")
    assert not syntax.annotated("def f(*, k: int): pass") and syntax.annotated("x: int = 1") and syntax.annotated("def f() -> int: pass")
    assert syntax.main_name("class A:\n  def m(self): pass\ndef top(): pass") == "top"
    assert (syntax.docstring(DOC), syntax.return_type("def f() -> int: pass"), syntax.parameters("def f(a, b=1, *c): pass"), syntax.returns(DOC), syntax.annotation_marks("def f(a: int): pass")) == ("d", "int", ["a"], True, True)


def test_execute_and_validate(spark):
    assert validate.execute("print(1)")[:2] == (True, "1\n") and not validate.execute("1/0")[0]
    assert validate.execute("x = 'a' * 10**9", memory_mb=200)[0] is False and validate.execute("print('a' * 10**7)")[1] == "a" * validate.OUTPUT
    ok, out, took = validate.execute("while True: pass", timeout=0.5)
    assert not ok and "timed out" in out and took < 5
    rows = [(1, "def f(x):\n    raise ValueError(1)"), (2, "1/0"), (3, None), (4, ""), (5, "def f(:"), (6, "def f(a: int, b):\n    return a + b\n")]
    df = spark.createDataFrame(rows, "id int, response string")
    out = {r["id"]: r for r in validate.validated(df).collect()}
    assert [out[i]["execution_valid"] for i in range(1, 7)] == [True, False, False, False, False, True]
    assert out[3]["execution_output"] == "No code provided" and out[3]["complexity"] is None and out[3]["function_name"] is None
    assert out[5]["complexity"] == 100 and out[6]["has_type_annotations"] and "Result: 15" in out[6]["execution_output"]
    assert validate.stats(df.limit(0).selectExpr("*", "true execution_valid")).collect()[0]["validation_rate"] == 0
    d = validate.directory_stats(df.selectExpr("id", "id > 2 execution_valid", "concat('f', id % 2) file"), "file").collect()[0]
    assert (d["total_files"], d["total_items"], d["valid_items"]) == (2, 6, 4)
    assert "## f0" in dataset.validation_report(validate.directory_stats(df.selectExpr("true execution_valid", "'f0' file"), "file")).collect()[0]["report"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"id": 1, "seed": "é"}\n\n  \nbroken\n5\n{"id": 2}\n{"id": 3.5, "seed": null, "more": 1}\n')
    (tmp_path / "sub" / "b.jsonl").write_text('{"id": 9, "seed": "z"}\n')
    rows = files.json_lines(spark, str(tmp_path), "id long, seed string").collect()
    assert sorted((r["id"] or 0, r["seed"] or "") for r in rows) == [(0, ""), (0, ""), (1, "é"), (2, "")]
    assert files.json_lines(spark, str(tmp_path), "id long, seed string", recursive=True).count() == 5
    assert [r["value"] for r in files.json_lines(spark, str(tmp_path), "value string").collect() if r["value"]] == ["5"]
    assert [r["n"] for r in files.skipped_lines(spark, str(tmp_path)).collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, seed string", strict=True).collect()
    assert files.files(spark, str(tmp_path)).count() == 2 and files.files(spark, str(tmp_path), recursive=False).count() == 1
    assert files.count_lines(spark, str(tmp_path / "a.jsonl")) == 7 and files.count_lines(spark, str(tmp_path / "a.jsonl"), blank=False) == 5
    assert files.table_or_lines(spark, str(tmp_path / "a.jsonl"), "id long, seed string").count() == 4
    assert files.count_lines(spark, str(tmp_path / "none")) == 0 and files.first_files(files.files(spark, str(tmp_path)), 1).collect()[0]["path"].endswith("a.jsonl")


@pytest.mark.parametrize("name", ["a.ndjson", "a.txt", "a"])
def test_json_lines_of_any_name(spark, tmp_path, name):
    (tmp_path / name).write_text('{"id": 1}\n{"id": 2}\n')
    for path in (tmp_path, tmp_path / name):
        assert files.json_lines(spark, str(path), "id long").count() == 2
        assert files.table_or_lines(spark, str(path), "id long").count() == 2


def test_limits_and_numbers(spark):
    df = spark.range(50).repartition(7)
    rows = files.numbered(df, "id").orderBy("id").collect()
    assert [r["ordinal"] for r in rows] == list(range(50))
    wide = files.numbered(spark.range(400_000).selectExpr("pmod(hash(id), 300000) k", "md5(string(id)) payload"), "k")
    assert wide.selectExpr("count(distinct ordinal)", "min(ordinal)", "max(ordinal)").collect()[0] == (400_000, 0, 399_999)
    assert files.sliced(files.numbered(df, "id"), "ordinal", 40, 0).count() == 10 and files.first_rows(df, 0).count() == 0 and files.first_rows(df, None).count() == 50


def test_blobs(spark, tmp_path):
    data = {"a": gzip.compress("é".encode()), "b": "é".encode("latin-1"), "c": b"\x1f\x8bno gzip", "d": b"\xff"}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    rows = spark.createDataFrame([("a", None), ("b", "latin-1"), ("c", "latin-1"), ("d", "no such"), ("gone", "utf-8")], "blob_id string, src_encoding string")
    got = {r["blob_id"]: r["content"] for r in blobs.fetched(rows, blobs.blob_files(spark, str(tmp_path))).collect()}
    assert got == {"a": "é", "b": "é", "c": "\x1f\x8bno gzip", "d": "\ufffd"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("",), ("a",), (None,)], "content string")
    assert [(r["id"], r["seed"]) for r in sinks.seed_rows(df).orderBy("id").collect()] == [(2, "a"), (3, "b")]
    sinks.write_json_lines(df, str(tmp_path / "j"), one_file=True)
    (part,) = (tmp_path / "j").glob("part-*")
    assert sum(json.loads(x) == {"content": None} for x in part.read_text().splitlines()) == 1
    sinks.write_table(df.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["content"]
    rows = spark.createDataFrame([("", "x"), ("y", "z"), (None, None)], "content string, seed string")
    assert [(r["id"], r["seed"]) for r in sinks.seed_rows(rows).orderBy("id").collect()] == [(1, "x"), (2, "y")]
    assert [r["content"] for r in sinks.function_rows(rows).orderBy("id").collect()] == [None, "", "y"]
    assert json.loads(sinks.stats_text(seeds.seed_stats(df.limit(0)))) == {"raw_functions": 0, "filtered_functions": 0, "filter_rate": 0.0}


def test_pipeline_resumes(spark, tmp_path):
    source = spark.createDataFrame([(DOC.replace("f(", f"f{i}("),) for i in range(4)] + [(DOC.replace("d", "TODO", 2),)], "content string")
    first = Pipeline(spark, str(tmp_path), note=1)
    out = first.run(source)
    assert out["final"].count() == 4 and "- final pairs: 4" in out["report"].collect()[0]["report"] and not first.missing()
    again = Pipeline(spark, str(tmp_path), note=1)
    again.run(source)
    assert again.ran == [] and Pipeline(spark, str(tmp_path), note=2).missing()


def test_pipeline_runs_again_for_other_input_model_or_checker(spark, tmp_path):
    source = spark.createDataFrame([(DOC,)], "content string")
    Pipeline(spark, str(tmp_path)).run(source)
    more = spark.createDataFrame([(DOC.replace("f(", f"g{i}("),) for i in range(3)], "content string")
    for files_, options in ((more, {}), (source, {"checker": "none"}), (source, {"samples": (2, 1, 1)}), (source, {"name": "x"})):
        run = Pipeline(spark, str(tmp_path))
        out = run.run(files_, **options)
        assert run.ran and out["final"].count() == (3 if files_ is more else 2 if "samples" in options else 1)


def test_checkers(spark):
    df = spark.createDataFrame([(DOC, 1), ("def (:", 2)], "content string, id int")
    assert [r["id"] for r in seeds.checked(df, "compile").collect()] == [1] and seeds.checked(df, "none").count() == 2
    with pytest.raises(RuntimeError):
        seeds.checked(df, "mypy")


def test_type_checker_in_batches(spark, tmp_path, monkeypatch):
    """A stand-in for the type checker: rejects files that hold `bad`, breaks off (naming no file) at `crash`."""
    tool = tmp_path / "mypy"
    tool.write_text(
        "#!/usr/bin/env python3\nimport sys\nassert sys.argv[1:4] == ['--python-version', '3.8', '--no-error-summary']\nrc = 0\n"
        "for f in sys.argv[4:]:\n    t = open(f).read()\n    assert t.startswith('# mypy: ignore-missing-imports')\n"
        "    if 'crash' in t:\n        sys.exit(2)\n    if 'bad' in t:\n        print(f + ':3: error: no')\n        rc = 1\nsys.exit(rc)\n"
    )
    tool.chmod(0o755)
    import os

    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    import pandas as pd

    assert seeds.default_checker() == "mypy"
    assert seeds.by_mypy(pd.Series(["x", "bad", "y"])).tolist() == [True, False, True]
    assert seeds.by_mypy(pd.Series(["x", "crash", "y", "bad"])).tolist() == [True, False, True, False]
    assert seeds.with_stubs("import a.b\nfrom a import c\n").count("import a\n") == 1
    df = spark.createDataFrame([(DOC.replace("x", v),) for v in ("good", "bad")], "content string")
    stats = seeds.seed_stats(df, df.filter("content like '%good%'")).collect()[0]
    assert (stats["raw_functions"], stats["filtered_functions"], stats["filter_rate"]) == (2, 1, 50.0)


def test_model_adapter(monkeypatch):
    """The adapter against stand-ins of the two libraries."""
    import contextlib
    import sys
    import types

    from siltstone.operators import models

    made = {}

    class Tokenizer:
        pad_token, eos_token, eos_token_id = None, "</s>", 7

        def __call__(self, texts, **options):
            made["call"] = options
            return {"ids": texts}

        def batch_decode(self, out, **options):
            return [f"{x}!" for x in out]

    class Model:
        def generate(self, ids, **options):
            made["generate"] = options
            return ids

    torch = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False), float32="f32", manual_seed=lambda s: made.update(seed=s), no_grad=contextlib.nullcontext)
    load = lambda thing: types.SimpleNamespace(from_pretrained=lambda path, **o: made.update({type(thing).__name__: o}) or thing)
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=load(Tokenizer()), AutoModelForCausalLM=load(Model())))
    model = models.causal("path")()
    assert model.generate(["a", "b"], [5, 6], temperature=0.7, max_new_tokens=3) == ["a!", "b!"]
    assert made["seed"] == 5 and made["Tokenizer"]["padding_side"] == "left" and made["Model"]["torch_dtype"] == "f32" and made["call"]["padding"]
    assert made["generate"] == {"do_sample": True, "pad_token_id": 7, "temperature": 0.7, "max_new_tokens": 3}
    assert models.load_options("4bit")["quantization_config"] == {"load_in_4bit": True} and "quantization_config" not in models.load_options("none")
    with pytest.raises(ValueError, match="quantization"):
        models.causal("path", "2bit")


def test_logs(tmp_path, monkeypatch, capsys):
    import sys

    from siltstone import logs

    monkeypatch.setenv("OPENAI_API_KEY", "very-secret")
    logger = logs.routed(str(tmp_path / "log"), "siltstone.test")
    logger.debug("fine detail")
    logger.info("key %s", "very-secret")
    assert logs.relayed([sys.executable, "-c", "import sys; print('one'); print('two', file=sys.stderr); sys.exit(3)"], logger) == 3
    told = (tmp_path / "log").read_text()
    assert all(x in told for x in ("fine detail", "key ***", "INFO one", "WARNING two")) and "very-secret" not in told
    err = capsys.readouterr().err
    assert "fine detail" not in err and "one" in err


def test_runners(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    row = lambda i, code: json.dumps({"id": i, "response": code}) + "\n"
    (source / "a.jsonl").write_text("".join(row(i, f"x = {i}" if i < 3 else "1/0") for i in range(5)))
    (source / "sub" / "b.jsonl").write_text(row(9, None))
    schema = "id long, response string"
    flat = runners.validate_folder(spark, str(source), str(tmp_path / "o1"), schema)
    assert [(r["input_file"], r["total_items"], r["valid_items"]) for r in flat["file_stats"].collect()] == [("a.jsonl", 5, 3)]
    tree = runners.validate_folder(spark, str(source), str(tmp_path / "o2"), schema, max_items=2, recursive=True)
    assert sorted((r["input_file"], r["total_items"], r["valid_items"]) for r in tree["file_stats"].collect()) == [("a.jsonl", 2, 2), ("sub/b.jsonl", 1, 0)]
    assert "## sub/b.jsonl" in tree["report"].collect()[0]["report"] and tree["file_stats"].collect()[0]["processing_time"] > 0
    one = runners.validate_file(spark, str(source / "a.jsonl"), str(tmp_path / "o3"), schema)
    assert one["stats"].collect()[0]["validation_rate"] == 0.6 and files.json_lines(spark, str(tmp_path / "o3" / "validated.jsonl"), schema).count() == 5
    none = runners.validate_folder(spark, str(source), str(tmp_path / "o4"), schema, glob="*.nothing")
    assert none["aggregated"].count() == 0 and none["directory_stats"].collect()[0]["success_rate"] == 0
    spark.createDataFrame([(DOC,), (DOC,), ("x",)], "content string").write.parquet(str(tmp_path / "src"))
    out = runners.gather_seeds(spark, connectors.Folder(str(tmp_path / "src")), str(tmp_path / "o5"), checker="compile")
    assert [(r["id"], r["seed"]) for r in out["seeds"].collect()] == [(0, DOC)] and out["stats"].collect()[0]["filter_rate"] == 100
    assert connectors.contents(connectors.Folder(str(tmp_path / "src")), spark, 2).count() == 2


def test_blob_client(spark):
    rows = spark.createDataFrame([("a", "utf-8"), ("0", None)], "blob_id string, src_encoding string")
    assert [(r["blob_id"], r["content"]) for r in connectors.Blobs(Rows(rows), io_queries.store).load(spark).collect()] == [("a", "blob a")]


class Rows:
    def __init__(self, rows):
        self.rows = rows

    def load(self, spark):
        return self.rows


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(2):
        spark.createDataFrame([(DOC,), (DOC.replace("f(", f"g{part}("),)], "content string").coalesce(1).write.mode("append").parquet(source)
        gather(spark, source, "content string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["content"][:6] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["def f(", "def g0", "def g1"]
