"""Exact-duplicate index, bit-plane clustering and ranked search beside brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tontine.llm import bitplanes, exact, ranked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)

# --- exact duplicates ---------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, key long, digest string, keep_id string, n long, body int"


def copies(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = ["", "É a", "é a", "x" * 200_000, *(" ".join(rng.choice(["A", "b", "Cc", "déjà"]) for _ in range(rng.randint(1, 9))) for _ in range(300))]
    rows = [(i, rng.choice(base)) for i in range(900)] + [(i, "The Hot Text") for i in range(2000, 2400)]
    rows += [(7000, None), (None, None), (None, "only here, no id"), (None, "only here, no id"), (5, "again"), (5, "again"), (4, "Again")]
    return [(i, t, 0, "", "", 0, 1) for i, t in rows]


def brute_groups(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        body = (text or "").translate(FOLD)
        keep = max((i for i in groups[body] if i is not None), default=None)
        out.append((doc_id, keep, len(groups[body]), doc_id == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def found_groups(df) -> list[tuple]:
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("key_bits", "bucket_bytes"), [(60, 4 << 20), (60, 2000), (3, 500)])
def test_exact_groups_equal_brute_force(spark, key_bits, bucket_bytes):
    rows = copies()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = exact.dedup(docs, key_bits=key_bits, bucket_bytes=bucket_bytes)
    assert found_groups(got) == brute_groups(rows)
    if key_bits == 3:  # eight keys: nearly every text lies in a chain
        assert got.selectExpr("max(chain)").first()[0] > 10


def test_exact_of_nothing(spark):
    assert exact.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_index_grows_by_splitting(spark, tmp_path):
    """Two insertions give the groups of one; the second splits what overflows and leaves other buckets where they are."""
    rows, path = copies(), str(tmp_path / "index")
    exact.create(spark, path)
    first = exact.insert(spark, path, spark.createDataFrame(rows[:40], DOCS), bucket_bytes=3000)
    second = exact.insert(spark, path, spark.createDataFrame(rows[40:], DOCS).repartition(3), bucket_bytes=3000)
    assert second.depth > first.depth and len(second.buckets) > len(first.buckets)
    assert all(b.n_bytes <= 3000 or b.n_texts == 1 for b in second.buckets)
    spans = sorted((second.first_key(b), 1 << (60 - b.depth)) for b in second.buckets)
    assert spans[0][0] == 0 and sum(n for _, n in spans) == 1 << 60
    assert all(a + n == b for (a, n), (b, _) in zip(spans[:-1], spans[1:]))
    links = exact.read_index(spark, path).collect()
    want = Counter((t or "").translate(FOLD) for _, t, *_ in rows)
    assert {bytes(r.body).decode(): r.group_size for r in links} == want and len(links) == len(want)
    assert sum(b.n_texts for b in second.buckets) == len(want)
    one = exact.insert(spark, path, spark.createDataFrame([(9999, "THE HOT TEXT", 0, "", "", 0, 1)], DOCS), bucket_bytes=3000)
    homes = {b.home for b in one.buckets}
    assert one.version == 3 and homes == {2, 3} and sum(b.home == 3 for b in one.buckets) == 1
    hot = [r for r in exact.read_index(spark, path).collect() if bytes(r.body) == b"the hot text"]
    assert [(r.keep_id, r.group_size) for r in hot] == [(9999, 401)]
    before = [r for r in exact.read_index(spark, path, 2).collect() if bytes(r.body) == b"the hot text"]
    assert [(r.keep_id, r.group_size) for r in before] == [(2399, 400)]  # older versions stay readable


def test_equal_digests_of_different_texts_are_refused(spark):
    directory = exact.Directory(1, 60, (exact.Bucket(0, 0),))
    rows = [(0, 5, b"d", b"one", 1, 1), (0, 5, b"d", b"two", 2, 1)]
    folded = spark.createDataFrame([(a, b, bytearray(c), bytearray(d), e, f) for a, b, c, d, e, f in rows], exact.FOLDED)
    with pytest.raises(Exception, match="two texts share the digest"):
        exact.owned_chains(spark, folded, directory).collect()


# --- bit planes ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1, 63, 64, 5000, (1 << 27) - 1])
def test_plane_products_are_exact(most):
    rng = np.random.default_rng(most % 1000)
    a, c = rng.integers(-most, most + 1, (50, 64)), rng.integers(-most, most + 1, (5, 64))
    a[0], c[0] = -most, most
    planes = bitplanes.planes_needed(most)
    rows, centres = bitplanes.pack(a, planes), bitplanes.pack(c, planes)
    assert (bitplanes.dots(rows, centres) == a @ c.T).all()
    assert (bitplanes.norms(rows) == (a * a).sum(axis=1)).all()
    want = ((a[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    best, gap = bitplanes.nearest(rows, centres)
    assert (best == want.argmin(axis=1)).all() and (gap == want.min(axis=1)).all()
    back = sum(int(w) * bitplanes.component_bits(rows[:, i]).astype(np.int64) for i, w in enumerate(bitplanes.weights(planes)))
    assert (back == a).all()


VECTORS = "vec_id long, embedding array<float>, cluster int, words array<long>, v long"


def brute_clusters(rows, k=16, rounds=3):
    kept = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members: dict[int, list] = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums.values()), names[c]) for i, c, d in found), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 64)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third are copies
    rows += [(3, rows[4][1]), (None, rows[9][1]), (2000, None), (2001, [1.0] * 63), (2002, [1.0, None] * 32), (2003, [float("inf")] * 64), (2004, [])]
    rows = [(i, v, 0, [1], 1) for i, v in rows]
    got = bitplanes.cluster(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64, 0, [1], 1) for i in range(n)]
    got = bitplanes.cluster(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows)


def test_large_components_are_refused_not_clipped(spark):
    rows = [(1, [3e6] * 64, 0, [1], 1), (2, [0.0] * 64, 0, [1], 1)]
    with pytest.raises(Exception, match="would not fit a long"):
        bitplanes.cluster(spark.createDataFrame(rows, VECTORS)).collect()


# --- ranked search ------------------------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, item int, score long, n long, terms string"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t, *_ in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    least: dict = {}
    for item, text, *_ in items:
        if text is not None:
            least[item] = min(least.get(item, text), text)
    out = []
    for item, text in least.items():
        scores = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in TERM.findall(text.translate(FOLD))
                if t in c
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(seed: int = 2):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gaMMa", "δέλτα", "É", "x1", "99", "the", "of", *(f"w{i}" for i in range(60))]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(1500)]
    docs += [(5000 + i, "The alpha of beta") for i in range(400)]  # ties beyond every tile
    docs += [(1, None), (2, ""), (3, "?! --"), (None, "alpha alpha"), (7, "x1 " * 30_000), (5001, "The alpha of beta")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)]
    items += [(100, "alpha"), (101, None), (102, "..."), (103, "unseenword"), (None, "beta beta beta"), (100, "beta"), (104, "the " * 5000)]
    return [(i, t, 0, 0, 0, "") for i, t in docs], [(i, t, 0, 0) for i, t in items]


@pytest.mark.parametrize("block_cells", [1 << 23, 900])
def test_ranks_equal_brute_force(spark, block_cells):
    docs, items = texts()
    frame = spark.createDataFrame(docs, TEXTS).repartition(3)
    got = ranked.search(frame, spark.createDataFrame(items, ITEMS), block_cells=block_cells)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, items)


def test_vocabulary_tiles_stay_exact():
    rng = np.random.default_rng(4)
    asked = rng.integers(0, 9_000_000, (3, 40)).astype(float)
    weight = rng.integers(1, 26_000, 40)
    cuts = ranked.vocabulary_cuts(asked, weight)
    assert len(cuts) > 3
    rows, columns = np.repeat(np.arange(40), 6), np.tile(np.arange(6), 40)
    impact = rng.integers(0, 1_000_001, 240)
    want = np.zeros((3, 6), object)
    for r, c, x in zip(rows, columns, impact):
        for i in range(3):
            want[i, c] += int(asked[i, r]) * int(weight[r]) * int(x)
    assert (ranked.tile_scores(asked, weight, rows, columns, impact, 6) == want).all()


def test_no_documents_or_items(spark):
    docs, items = texts()
    some, none = spark.createDataFrame(docs[:5], TEXTS), spark.createDataFrame([], TEXTS)
    assert ranked.search(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert ranked.search(some, spark.createDataFrame([], ITEMS)).collect() == []
