"""Top-k, archive, sharding and token output: brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tontine.llm import sharding, tokens, topk, warc

VECTORS = "vec_id long, embedding array<float>, rank int, score long"


def brute_top(rows, k=5):
    best = {}
    for vec_id, vector, *_ in rows:
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            vector = [float(np.float32(x)) for x in vector]
            best[vec_id] = min(best.get(vec_id, vector), vector)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in best.items()}
    out = set()
    for q, v in whole.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v)]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize(("groups", "bands", "block"), [(40, 3, 4), (8192, 8192, 64)])
def test_top_k_equals_brute_force(spark, groups, bands, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 0, 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0, 0) for i in range(30)]  # ties
    rows += [(50, [0.5] * 8, 0, 0), (100, None, 0, 0), (2000, [], 0, 0), (2001, [1.0, None] * 4, 0, 0), (None, [1.0] * 8, 0, 0)]
    rows += [(2002, [float("nan")] * 8, 0, 0), (2050, [1.0, -2.0], 0, 0), (2051, [3.0, 4.0], 0, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = topk.top_k(df, F.col("id") % 50 == 0, group_rows=groups, band_queries=bands, block=block).collect()
    assert {tuple(r) for r in got} == brute_top(rows)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0).collect() == []


PAGES = "page_id long, url string, html string, digest string, header string"


def test_archive_round_trip(spark, tmp_path):
    long = "x" * 120 + "é"
    rows = [(3, "http://a/", long, None, None), (1, None, long, None, None), (2, "u\r\nWARC-Type: x", "short", None, None),
            (5, "", None, None, None), (4, "b", "short", None, None), (None, "c", long, None, None), (1, None, long, None, None)]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(2), path)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(spark, path).collect()}
    assert got == {(3, "revisit", 1, 122), (1, "response", None, 122), (2, "response", None, 5), (5, "response", None, 0),
                   (4, "response", None, 5), (None, "revisit", 1, 122)}
    blobs = spark.read.parquet(path + "/blobs").collect()
    assert len(blobs) == 3 and all(hashlib.sha256(b.payload).hexdigest() == b.digest for b in blobs)
    for record in warc.rebuild_records(spark, path).collect():
        head, _, body = bytes(record.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\nWARC-Type: x" not in head
        assert body == (b"" if b"revisit" in head else bytes(record.payload)) + b"\r\n\r\n"


def test_damaged_blob_is_noticed(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc", None, None)], PAGES), path)
    blobs = spark.createDataFrame([tuple(r) for r in spark.read.parquet(path + "/blobs").collect()], "digest string, n_bytes long, response_id long, payload binary")
    blobs.withColumn("payload", F.lit(b"abd")).write.mode("overwrite").parquet(path + "/blobs")
    with pytest.raises(Exception, match="damaged blob"):
        warc.read_records(spark, path).collect()


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_records(spark, path).count() == 0


TEXTS = "doc_id long, text string, slot long, shard int"


def test_shards_are_gapless_and_near_equal(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    placed, _, _ = sharding.shard(documents, 6)
    rows = placed.collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    load, places = [0] * 6, [[] for _ in range(6)]
    for r in rows:
        assert r["size"] == len((texts[r.key] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((texts[r.key] or "").encode())
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) <= max(r["size"] for r in rows)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, 1, 1), (None, "", 1, 1), (7, "same", 1, 1), (7, "same", 1, 1), (8, "é", 1, 1)]
    got = sharding.shard(spark.createDataFrame(rows, TEXTS), 2)[0].collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 40 + 10
    assert sharding.shard(spark.createDataFrame([], TEXTS), 2)[0].count() == 0


def test_map_versions(spark, tmp_path):
    size = [((i * 37) % 101) * 10 for i in range(500)]
    first = sharding.first_map(size, 8)
    grown = sharding.grow(first, size)
    moved = [s for s in range(500) if first.shard_of[s] != grown.shard_of[s]]
    assert moved and all(grown.shard_of[s] == 8 for s in moved)
    load = lambda m: [sum(z for z, x in zip(size, m.shard_of) if x == s) for s in range(m.shards)]
    assert max(load(first)) - min(load(first)) <= max(size)
    assert load(grown)[8] > 0.8 * sum(size) / 9
    changed = [z * 4 if first.shard_of[i] == 0 else z for i, z in enumerate(size)]
    evened = sharding.rebalance(first, changed)
    spread = lambda m: max(sum(z for z, x in zip(changed, m.shard_of) if x == s) for s in range(8))
    assert spread(evened) < 1.05 * sum(changed) / 8 < spread(first)
    path = str(tmp_path / "map")
    sharding.store_map(spark, [first, grown], path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == first


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 17, 1000):
        order = tokens.Feistel(n, 5)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.index(slots) == np.arange(n)).all()
    assert (tokens.Feistel(1000, 5).slot(np.arange(1000)) != tokens.Feistel(1000, 6).slot(np.arange(1000))).any()


def test_token_shards_round_trip(spark, tmp_path):
    rows = [(1, "one two  three\n four " * 40, 0, 0), (2, "", 0, 0), (3, None, 0, 0), (None, "x", 0, 0), (5, "longword" * 300, 0, 0), (5, "longword" * 300, 0, 0)]
    path = str(tmp_path / "order")
    tokens.materialise(spark.createDataFrame(rows, TEXTS).repartition(3), path, length=16, rows_per_shard=8)
    got = tokens.read_shards(spark, path).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(r.shard == r.slot // 8 for r in got)
    assert {len(r.tokens) for r in got} == {32}
    coder = tokens.Tokenizer(open(tokens.RANKS, "rb").read()).coder
    spelled = []
    for key, part_rows in ((1, 1), (None, 1)):
        parts = sorted((r.part, np.frombuffer(r.tokens, "<u2")[: r.n_tokens]) for r in got if r.doc_id == key)
        ids = np.concatenate([p for _, p in parts]).tolist()
        assert ids[-1] == tokens.END
        spelled.append(coder.decode(ids[:-1]))
    assert spelled == [rows[0][1], "x"]
    rest = tokens.read_shards(spark, path, from_slot=11).collect()
    assert sorted(r.slot for r in rest) == list(range(11, len(got)))


def test_no_tokens(spark, tmp_path):
    path = str(tmp_path / "order")
    tokens.materialise(spark.createDataFrame([(1, None, 0, 0)], TEXTS), path)
    assert tokens.read_shards(spark, path).count() == 0
