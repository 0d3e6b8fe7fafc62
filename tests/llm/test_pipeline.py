"""The pipeline: each stage against brute force on the rows that its predecessor kept."""

from __future__ import annotations

import corpus_pipeline as pipeline
from tontine.llm import quality
from tontine.sources.shared import spool

from test_texts import components_by_hand, leaks_by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES][-1] == "sentencepiece" and len(pipeline.STAGES) == 5
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(spool(stage(spark, kept[-1], sf), name))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [k.collect() for k in kept]
    # quality: what the model scores, nothing else
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").filter(~pipeline.held_out()))
    good = {r.key for r in quality.score(docs, model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in rows[1]} == good
    # lines: no row goes, texts lose whole lines only
    before = {r.doc_id: r.text for r in rows[1]}
    assert {r.doc_id for r in rows[2]} == set(before)
    for r in rows[2]:
        lines = iter((before[r.doc_id] or "").split("\n"))
        assert r.text == before[r.doc_id] or r.text == "" or all(line in lines for line in r.text.split("\n"))
        assert r.n_chars == len(r.text) or r.text == before[r.doc_id]
    # one row per component
    want = {component for _, _, component in components_by_hand([(r.doc_id, r.text) for r in rows[2]])}
    assert sorted(r.doc_id for r in rows[3]) == sorted(want)
    # clean rows stay
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r.text for r in rows[3]]
    dirty = {rows[3][i].doc_id for i, _ in leaks_by_hand(texts, items)}
    gone = {r.doc_id for r in rows[3]} - {r.doc_id for r in rows[4]}
    assert gone <= dirty and len(gone) >= 0.95 * len(dirty)
    assert {r.doc_id for r in rows[5]} == {r.doc_id for r in rows[4]} and all(r.decodes for r in rows[5])
