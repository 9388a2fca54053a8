"""Native text operators: edge cases, and random comparison with Python's re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import generate, prompts
from siltstone.sources import files


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", make(F.col("c")).alias("o")).orderBy("i").collect()]


def soup(seed, pieces, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_predicates(spark):
    assert column(spark, ["denote", "Todo Note:", "prefix_bug", "x", None], text.no_banned_word) == [False, True, False, True, None]
    assert column(spark, ["import os.path", "import json, os", "from .os import x", "  from sys import a"], text.no_forbidden_import) == [False, True, True, False]
    assert column(spark, ["return", "Returns: x", "áreturn", "# return."], text.has_return) == [True, False, False, True]
    cases = ["def f():", "def f(self):", "def f(cls):", "def f(\n a):", "def f(\n a):\n  def g(b):", "no"]
    assert column(spark, cases, text.has_args) == [False, False, True, False, True, False]


def test_imports_like_re(spark):
    rows = soup(1, ["import ", "from ", "os", "a.b", "\n", "\r\n", " ", "\xa0", "\x85", "\u2028", "\t", "x, y"])
    pattern = re.compile(r"^\s*(?:from|import)\s+([a-zA-Z0-9_.]+)", re.MULTILINE)
    want = [list(dict.fromkeys(m.split(".")[0] for m in pattern.findall(r))) for r in rows]
    assert column(spark, rows, text.imports) == want and any(want)


def test_strip_and_sanitize_like_re(spark):
    rows = soup(2, [" ", "\n", "\xa0", "\u2003", "\x1c", "a", "\x85", "\u200b"])
    assert column(spark, rows, text.strip) == [r.strip() for r in rows]
    rows = soup(3, ["import os", "import sys", "from os import x", "from os.path import y", "import osgeo", "\n", "  ", "\r\n", "open (", "literal_eval(", "exec(", "x"], 250)

    def python(code):
        for name in text.REMOVED_IMPORTS:
            for tail in (rf"import\s+{name}.*?", rf"from\s+{name}\s+import.*?"):
                code = re.sub(rf"(^|\n)(\s*){tail}($|\n)", rf"\1\2{text.REMOVED_NOTE}{name}\3", code)
        for name in ("open", "eval", "exec"):
            code = re.sub(rf"{name}\s*\(", f"# {name}(", code)
        return code

    assert column(spark, rows, text.sanitized) == [python(r) for r in rows]
    assert column(spark, ["import os\nimport os\n"], text.sanitized) == [f"{text.REMOVED_NOTE}os\nimport os\n"]


def test_post_processing(spark):
    cases = ["```python\na\n``` x", "```py\nb```", "`````` ```c```", "  all \n", "no fence```"]
    assert column(spark, cases, text.code_of) == ["a", "py\nb", "", "all", "no fence```"]
    cut = ["do\\nInstruction: x", "do\nInstruction: x", "\\nDescription: a", "plain "]
    assert column(spark, cut, text.truncated) == ["do", "do\nInstruction: x", "", "plain"]
    newline = tuple(t.replace("\\n", "\n") for t in text.TERMINATORS)
    assert column(spark, cut[1:2], lambda c: text.truncated(c, newline)) == ["do"]
    assert column(spark, ["", "`````` x", " ok "], lambda c: text.after_mode(c, "I->R")) == [None, None, "ok"]
    with pytest.raises(ValueError):
        text.after_mode(F.lit("x"), "X")
    tags = ["a <response> b </response> c", "<response>open end ", "0123456789abc"]
    assert column(spark, tags, text.tagged_response) == ["b", "open end", "9abc"]
    assert column(spark, ["P: out ", "other", ""], lambda c: text.completion(F.lit("P:"), c)) == ["out", "other", ""]


def test_values(spark):
    assert column(spark, ["12", "1.5", ".5", "-3", "1e5", "", "1.2.3"], text.typed) == ["int", "float", "float", "string", "string", "string", "string"]
    assert [files.setting(v, 7) for v in ("12", "1.5", "-3", None)] == [12, 1.5, "-3", 7]
    assert column(spark, ["0", "1536", str(5 * 1024**4)], lambda c: text.humanized(c.cast("double"))) == ["0.0 B", "1.5 KB", "5.0 TB"]
    assert files.secret("openai", {"OPENAI_API_KEY": "your_key"}) == "" and files.secret("openai", {"OPENAI_API_KEY": "k"}) == "k"
    with pytest.raises(ValueError):
        files.secret("x", {})


def test_prompts(spark):
    df = spark.createDataFrame([("{brace} code",)], "seed string")
    row = prompts.prompted(df, "S->C").collect()[0]["prompt"]
    assert "{brace} code" in row and row.count("Description:") == 3
    assert prompts.prompted(df, "S->C", samples=3).count() == 3
    chat = prompts.prompted(df, "S->C", chat_format=True).collect()[0]["prompt"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant", "user", "assistant", "user"]
    with pytest.raises(ValueError):
        prompts.plain("C->X")


class Echo:
    def generate(self, prompts, seeds, **options):
        return [p + f"Idea {s % 7}" for p, s in zip(prompts, seeds, strict=True)]


def test_generation(spark):
    df = spark.range(20).selectExpr("id", "concat('def f', id) seed").repartition(3)
    a = {r["id"]: r["concept"] for r in generate.stage(df, "S->C", Echo, batch_size=3).collect()}
    b = {r["id"]: r["concept"] for r in generate.stage(df.coalesce(1), "S->C", Echo).collect()}
    assert a == b and len(a) == 20 and all(v.startswith("Idea ") for v in a.values())
    out = generate.chain(df).collect()
    assert len(out) == 20 and out[0]["response"].startswith("def solve(x):")
