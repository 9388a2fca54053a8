"""The pipeline against brute force, stage by stage."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import quality, queries, secrets
from tests.llm.test_op07_jaccard import brute as components
from tests.llm.test_op09_decontaminate import brute as hits

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, queries.quality_model(docs, spark, SF)).collect()}
    keep = {d: t for d, t in rows.items() if scores[d] >= 0.5}
    assert 0.5 * len(rows) < len(keep) < len(rows)
    heads = {c for i, _, c in components(list(keep.items()), 5, 80) if i == c}
    keep = {d: t for d, t in keep.items() if f"{d}" in heads}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {h[0] for h in hits(list(keep.items()), items, 10) if h[-1]}
    assert bad
    keep = {d: t for d, t in keep.items() if str(d) not in bad}
    # the model is trained on what reaches the stage
    left = spark.createDataFrame(list(keep.items()), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(left).collect()}
    assert any(clean[d] != t for d, t in keep.items()) and len(clean) == len(keep)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in clean.items()}


def test_near_duplicate_stage_edge_cases(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (2, None), (4, ""), (4, ""), (None, "a b c d e f g"), (5, "other words of another text here")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, comp int")
    out = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").na.fill("").collect()) == [(1, "A b c d e f g"), (2, ""), (4, ""), (5, "other words of another text here")]


def test_empty(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.count() == 0
