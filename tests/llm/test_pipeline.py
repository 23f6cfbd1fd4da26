"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import corpus_pipeline as P
from lacuna.llm import decontam, pii
from lacuna.llm import queries as Q

from .test_text_ops import tiktoken_of


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    good = {r["doc_id"] for r in Q.op2_quality(spark, sf).where("predicted = 1").collect()}
    assert ids["quality"] == good
    firsts = {r["doc_id"] for r in Q.simhash.near_duplicates(seen["quality"]).where("doc_id = component_id").collect()}
    assert ids["near_duplicates"] == firsts
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    before = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in decontam.match(seen["near_duplicates"], bench).collect()}
    after = {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()}
    texts = {r["doc_id"]: r["text"] for r in seen["near_duplicates"].collect()}
    assert any(before.values())
    for i, n in before.items():
        if not n:
            assert after[i] == texts[i]
        elif i in after:
            assert len(decontam.words_of(after[i])) == len(decontam.words_of(texts[i])) - n
    for r in seen["pii"].collect():
        assert not any(s.kind in pii.BASE_KINDS for s in pii.find_spans(r["text"]))
    enc = tiktoken_of(Q.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    final = {r["doc_id"]: r["text"] for r in seen["pii"].collect()}
    for r in seen["tokens"].collect():
        assert r["ids"] == enc.encode_ordinary(final[r["doc_id"]])


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, docs.collect()))
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "tokens"]


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert [n for n in names if n.startswith("op")] == ["op1_pii", "op2_quality", "op3_orc_tokens", "op4_itq", "op5_simhash", "op6_warc", "op7_html", "op8_decontam", "op9_bpe", "op10_urls"]
    assert "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
