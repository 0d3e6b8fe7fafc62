"""Cases that once gave wrong or lost results."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tontine.llm import decontam, linededup, pieces, quality, sharding, tokens, topk


def test_large_components_are_not_clipped(spark):
    rows = [(0, [3e5]), (1, [4e5]), (2, [5e5]), (3, [-3e5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    whole = {i: int(256 * v[0]) for i, v in rows}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, whole[0] * whole[i]) for i in (2, 1, 3)]
    # Sums beyond the safe range of 64-bit products, but the scores themselves fit.
    rows = [(0, [1e16, 1.0]), (1, [1.0, 1e16]), (2, [2.0, 1e15])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, scale=1).collect()
    assert {r.vec_id: r.score for r in got} == {1: 2 * 10**16, 2: 2 * 10**16 + 10**15}
    rows = [(0, [1e18]), (1, [1e18])]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()


def test_equal_rows_are_spread_over_shards(spark):
    rows = [(7, "same text")] * 900 + [(None, None)] * 900 + [(i, f"text {i}") for i in range(600)]
    placed, _, _ = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 12)
    got = placed.collect()
    assert len(got) == len(rows)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 12
    assert all(abs(load[s] - mean) < 0.05 * mean for s in range(12))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_slots_stay_distinct_when_tasks_write_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * (i % 5 + 1)) for i in range(300)], "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "17")
    try:
        tokens.materialise(docs, str(tmp_path / "out"), length=4, rows_per_shard=50)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    slots = sorted(r.slot for r in tokens.read_shards(spark, str(tmp_path / "out")).select("slot").collect())
    assert slots == list(range(len(slots))) and len(slots) > 300


def test_items_without_an_id_are_searched_for(spark):
    passage = "one quick brown fox jumps over the lazy dog today"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "clean text of no interest to anyone at all here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontam.leaks(docs, items).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontam.keep_clean(docs, items).collect()] == [2]


def test_repeated_ids_do_not_widen_the_training_sample(spark):
    rows = [(i, f"text number {i} of copy {c}") for i in range(40) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sample, good, bad = quality.training_sample(docs, labels, "doc_id", "text", "quality", 100, 4)
    again, *_ = quality.training_sample(docs.repartition(5), labels, "doc_id", "text", "quality", 100, 4)
    assert len(sample) == 40 and good == bad == 20 and sample == again


def test_lines_on_one_to_four_percent_of_a_host_go(spark):
    rows = []
    for i in range(1000):
        lines = [f"own {i} a", f"own {i} b"]
        lines += ["on four percent"] * (i % 25 == 0) + ["on one and a half"] * (i % 66 == 0) + ["on half a percent"] * (i % 200 == 0)
        rows.append((i, "\n".join(lines), "hot"))
    rows += [(2000 + i, f"small host {i}\nits menu", "small") for i in range(6)]
    got = {r.doc_id: r.text for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()}
    left = collections.Counter(line for t in got.values() for line in t.split("\n"))
    assert left["on four percent"] == left["on one and a half"] == left["its menu"] == 0
    assert left["on half a percent"] == 5 and left["own 7 a"] == 1 and len(got) == 1006


def test_stages_bear_clashing_columns_nulls_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clash = docs.select(
        "*", *(F.lit(i).alias(c) for i, c in enumerate(("dropped_lines", "__n", "kept_id", "place", "node", "n", "lines", "host", "row", "score", "key", "cleaned", "dropped")))
    )
    nulls = clash.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in clash.schema.fields))
    rows = clash.union(nulls).union(nulls)
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns, name
        assert out.count() > 20 and out.filter("text IS NULL").count() == 2, name
        assert stage(spark, rows.limit(0), sf).count() == 0, name
    kept = pipeline.quality_stage(spark, rows, sf)
    assert kept.columns == rows.columns


def test_segmentations_do_not_depend_on_the_batch(spark, sf):
    """Two orders and partitionings: every value equal to the last bit."""
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += ["", None, "a  b", "▁x ▁ y", "naïve 漢字 😀 \n\t", "é" * 3000, " lead"] + texts[:9]
    rows = list(enumerate(texts))
    mixed = rows[:]
    rng.shuffle(mixed)

    def drawn(data, parts):
        out = pieces.encode(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
        return {(r.doc_id, r.sample): tuple(r) for r in out}

    first, second = drawn(rows, 1), drawn(mixed, 5)
    assert first == second and len(first) > 100
    assert all(r[-1] for r in first.values())
    decoded = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")))
    for r in decoded.collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    sampler = pieces.worker_sampler(open(pieces.MODEL, "rb").read(), 2, pieces.REMEMBERED)
    ids = [np.array(v[2], np.int32) for v in first.values() if texts[v[0]]]
    own = [texts[v[0]] for v in first.values() if texts[v[0]]]
    assert sampler.spell(ids, own).all()
    assert not sampler.spell(ids, [t + "x" for t in own]).any() and not sampler.spell(ids, ["q" + t[1:] + "~" for t in own]).any()
    assert not sampler.spell([x[:-1] for x in ids], own).any()
