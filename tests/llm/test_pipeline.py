"""The pipeline's stages against brute force: what each drops, and that it keeps the columns."""

import corpus_pipeline as P
import pytest
from test_corpus_operators import brute_components, naive_line_dedup

from skein.llm import decontaminate, langid, mixing


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The smallest documents, and rows that the language stage rejects."""
    more = [(90_001, "12 34 .. 56", "en", "x", 11), (90_002, "", "en", "x", 0), (90_003, None, None, "x", None), (None, "Straßen und Häuser der Stadt, die der Fluss an den Wiesen hat", "de", "x", 60)]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.createDataFrame(base.collect() + more, base.schema)


def test_language_stage(spark, sf_dir, docs):
    """What stays is what the network, trained anew on the same rows, tells at least as surely as the limit."""
    kept = {r["doc_id"] for r in P.language(spark, docs, sf_dir).collect()}
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, *langid.train(docs)).collect()}
    assert kept == {i for i, (lang, s) in told.items() if lang != "und" and s >= P.MIN_SCORE}
    assert {90_001, 90_002, 90_003}.isdisjoint(kept) and len(kept) >= len(told) - 6


def test_line_stage(spark, sf_dir, docs):
    named = docs.filter("doc_id is not null")
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    gone = naive_line_dedup(rows)
    want = {}
    for i, t in rows:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(gone[i]))
        if t is None or not gone[i] or left.strip(" "):
            want[i] = left
    out = P.line_dedup(spark, named, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in out)


def test_near_dedup_stage(spark, sf_dir, docs):
    rows = docs.filter("doc_id is not null").collect()
    found, _ = brute_components({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    got = {r["doc_id"] for r in P.near_dedup(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()}
    assert got == {i for i, c in found.items() if i == c}


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, before, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.join(before, "doc_id", "left_anti").count() == 0
        before = out
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not [r for r in before.collect() if any(t in r["text"] for t in items)]
    assert not [r for r in decontaminate.scan_benchmark(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r["contaminated"]]
    final = P.run(spark, sf_dir)
    got, want = {r["doc_id"] for r in final.collect()}, {r["doc_id"] for r in mixing.weigh(before).filter("kept").collect()}
    assert got == want and final.columns == [*docs.columns, "mix_tokens", "mix_probability", "mix_weight"]
