"""Benchmark decontamination: CGK random-walk embedding, bit-sampling search, exact edit verification.

Texts are read as words (ASCII letters in lower case, ASCII punctuation and white space as separators). A document is
contaminated by an item of ``n`` words if some item-sized window, ``n`` words from some start or what the text still has,
lies within ``k = floor(edit_share * n)`` word edits of it.

The CGK walk turns a window into ``3 n`` symbols: it stands on a word, emits it, and moves on or not by a random bit of
(step, word); equal walks meet again after an edit, so edit distance becomes Hamming distance. Each of ``WALKS`` walks is
sampled at ``SAMPLES`` random sets of ``BITS`` coordinates; a window and an item of its size are compared if they agree on
one of the samples. Candidates are verified by banded edit distance; recall of the search is measured in the tests.

An edit breaks two neighbouring pairs of words at most. So a window enters the walk only if it holds ``n - 1 - 2 k`` pairs
that occur in items of ``n`` words. Of one word repeated over and over only as many pairs count as an item has, and an
item that holds such pairs needs so many fewer; where none would be left, all pairs of the text count for that item.
Nothing is lost, and most text is passed over.

The items of one pass are bounded (``BLOCK_WORDS`` words); a larger benchmark is searched block by block.

Defined results
* null and empty texts are clean; items under ``least_words`` words (null and empty ones too) are not searched for;
* a document shorter than an item is compared whole; ties: the first window with the fewest edits is reported;
* repeated rows are answered each; repeated items each by its id; an empty benchmark leaves all documents clean;
* null ids are carried along, those of items too; extra columns are not read (``keep_clean`` hands them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine.llm.arrowtools import arrow_schema, member, mix64, slices
from tontine.llm.words import WordHashes

EDIT_SHARE = 0.2
LEAST_WORDS = 8
#: Tables of the search: WALKS * SAMPLES, each on BITS coordinates of the embedding.
WALKS, SAMPLES, BITS = 14, 8, 3
SEED = 20
MIX = 0x9E3779B97F4A7C15
BLOCK_WORDS = 1 << 20
#: Stands for a null id inside a block.
NO_ID = -(1 << 63)
#: Windows that walk together.
WALKING = 1 << 14


@dataclass(frozen=True)
class Items:
    """One block of items: word ids (from 1, by the order of ``vocabulary``) and the search tables."""

    ids: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    #: Hashes of the items' pairs of neighbouring words.
    pairs: np.ndarray
    #: Kinds of the items that hold pair ``i``: ``pair_kinds[first[i] : first[i + 1]]``.
    first: np.ndarray
    pair_kinds: np.ndarray
    #: Kinds of items, in order: words, and the most pairs of one repeated word that an item of the kind holds.
    kinds: np.ndarray
    #: The most times that one item holds each pair.
    times: np.ndarray
    keys: np.ndarray
    owners: np.ndarray


def limit(sizes: np.ndarray) -> np.ndarray:
    return np.floor(sizes * EDIT_SHARE + 1e-9).astype(np.int64)


def coordinates(n: int) -> np.ndarray:
    """Sampled coordinates of windows of ``n`` words: walks x samples x bits, the same in every task."""
    return np.random.default_rng((SEED, n)).integers(0, 3 * n, (WALKS, SAMPLES, BITS))


def walk_keys(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Search keys of windows ``words[start : start + length]`` for items of ``sizes`` words: windows x tables."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    at = np.stack([coordinates(int(n)) for n in kinds])
    out = np.empty((len(starts), WALKS * SAMPLES), np.uint64)
    window, steps = np.arange(len(starts)), 3 * int(kinds[-1])
    for w in range(WALKS):
        place = np.zeros(len(starts), np.int64)
        emitted = np.zeros((steps, len(starts)), np.int32)
        for step in range(steps):
            alive = place < lengths
            symbol = np.where(alive, words[np.minimum(starts + place, len(words) - 1)], 0)
            emitted[step] = symbol
            coin = mix64(symbol.astype(np.uint64) * np.uint64(MIX) + np.uint64((w << 32) + (step << 8) + SEED))
            place += alive & ((coin >> np.uint64(33)) & np.uint64(1)).astype(bool)
        for s in range(SAMPLES):
            key = ((sizes.astype(np.uint64) << np.uint64(16)) + np.uint64(w * SAMPLES + s)) * np.uint64(2) + np.uint64(1)
            for bit in range(BITS):
                symbol = emitted[at[kind, w, s, bit], window].astype(np.uint64)
                key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + symbol)
            out[:, w * SAMPLES + s] = key
    return out


def edits(
    words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, items: np.ndarray, at: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """Word edit distance of each window to ``items[at : at + size]``, exact up to ``limit(size)``, above it anything larger."""
    most = limit(sizes)
    band, longest = int(most.max()), int(sizes.max())
    far, width = band + 1, 2 * band + 1
    offsets = np.arange(width) - band
    # cell[:, b]: distance of item[:i] and window[: i + offsets[b]]
    cell = np.where(offsets >= 0, np.minimum(offsets, far), far)[None, :].repeat(len(starts), 0)
    out = np.full(len(starts), far, np.int64)
    column = lengths - sizes + band
    for i in range(1, longest + 1):
        own = items[np.minimum(at + i - 1, len(items) - 1)]
        fresh = np.full_like(cell, far)
        for b in range(width):
            j = i + offsets[b]
            if j < 0:
                continue
            if j == 0:
                fresh[:, b] = min(i, far)
                continue
            symbol = words[np.minimum(starts + j - 1, len(words) - 1)]
            best = cell[:, b] + (symbol != own)
            if b + 1 < width:
                best = np.minimum(best, cell[:, b + 1] + 1)
            if b:
                best = np.minimum(best, fresh[:, b - 1] + 1)
            fresh[:, b] = np.where(j <= lengths, np.minimum(best, far), far)
        cell = fresh
        ended = np.flatnonzero((sizes == i) & (column >= 0) & (column < width))
        out[ended] = cell[ended, column[ended]]
    return out


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; one less than the words."""
    with np.errstate(over="ignore"):
        return mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def build_items(ids: list, texts: list[str | None], least_words: int = LEAST_WORDS) -> Items:
    """Items of one block with their search tables."""
    hashes, at = WordHashes(punctuation=True).of(pa.array(texts, pa.string()))
    sizes = np.diff(at)
    chosen = np.flatnonzero(sizes >= least_words)
    vocabulary = np.unique(np.concatenate([hashes[at[i] : at[i + 1]] for i in chosen])) if len(chosen) else hashes[:0]
    words = np.concatenate([hashes[at[i] : at[i + 1]] for i in chosen]) if len(chosen) else hashes[:0]
    numbered = (np.searchsorted(vocabulary, words) + 1).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes[chosen])))[:-1].astype(np.int64)
    joined = pair_hashes(words)
    inner = np.ones(len(words), bool)
    inner[starts[1:] - 1] = False
    item_of = np.repeat(np.arange(len(chosen)), sizes[chosen])
    inner = np.flatnonzero(inner[: len(joined)])
    pairs = np.unique(joined[inner])
    number = np.searchsorted(pairs, joined[inner])
    width = len(pairs) + 1
    held, counts = np.unique(item_of[inner] * width + number, return_counts=True)
    times = np.zeros(len(pairs), np.int64)
    np.maximum.at(times, held % width, counts)
    doubled = np.flatnonzero(words[:-1] == words[1:])
    doubled = doubled[np.isin(doubled, inner)]
    spare = np.zeros(len(chosen), np.int64)
    code = item_of[doubled] * width + np.searchsorted(pairs, joined[doubled])
    np.maximum.at(spare, item_of[doubled], counts[np.searchsorted(held, code)])
    kinds, kind = np.unique(np.stack((sizes[chosen], spare), 1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    by_pair = np.unique(np.stack((number, kind[item_of[inner]]), 1), axis=0).reshape(-1, 2)
    first = np.searchsorted(by_pair[:, 0], np.arange(width))
    keys, owners = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(chosen):
        keys = walk_keys(numbered, starts, sizes[chosen], sizes[chosen]).ravel()
        owners = np.repeat(np.arange(len(chosen)), WALKS * SAMPLES)
    order = np.argsort(keys, kind="stable")
    names = np.array([ids[i] for i in chosen], np.int64)
    return Items(names, numbered, starts, sizes[chosen], vocabulary, pairs, first, by_pair[:, 1], kinds, times, keys[order], owners[order])


def windows(items: Items, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of the windows that hold enough pairs of items of that size."""
    joined = pair_hashes(hashes)
    place = np.flatnonzero(member(joined, items.pairs))
    if not len(place):
        return place, place
    number = np.searchsorted(items.pairs, joined[place])
    # Of a run of one pair (x x x ...) only the first that an item can match count.
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1] + 1) | (number[1:] != number[:-1]) | np.isin(place[1:], at)
    since = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
    counted = since < items.times[number]
    many = items.first[number + 1] - items.first[number]
    entry = np.repeat(items.first[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
    place, counted, kind = np.repeat(place, many), np.repeat(counted, many), items.pair_kinds[entry]
    # What a window within the limit must hold. One that starts inside of a run may hold as many pairs of it again.
    whole = items.kinds[:, 0] - 1 - 2 * limit(items.kinds[:, 0])
    folded = whole - items.kinds[:, 1]
    # Without folding, a kind whose items are little but one repeated word loses no window.
    needed = np.where(folded > 0, folded, whole)
    chosen = np.flatnonzero(counted | (folded <= 0)[kind])
    chosen = chosen[np.argsort(kind[chosen], kind="stable")]
    place, bounds = place[chosen], np.searchsorted(kind[chosen], np.arange(len(items.kinds) + 1))
    begin = at[np.searchsorted(at, place, side="right") - 1]
    starts: dict[int, list[np.ndarray]] = {}
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        n, least = int(items.kinds[i, 0]), int(needed[i])
        own = place[bounds[i] : bounds[i + 1]]
        near = own[least - 1 :] - own[: len(own) - least + 1] <= n - 2 if len(own) >= least else np.empty(0, bool)
        ok = np.flatnonzero(near)
        low = np.maximum(own[ok + least - 1] - (n - 2), begin[bounds[i] + ok])
        span = own[ok] - low + 1
        low, span = low[span > 0], span[span > 0]
        starts.setdefault(n, []).append(np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum()))
    found = {n: np.unique(np.concatenate(parts)) for n, parts in starts.items()}
    sizes = np.repeat(np.array(list(found), np.int64), [len(f) for f in found.values()])
    return np.concatenate([*found.values(), place[:0]]), sizes


def find(items: Items, column: pa.Array, hasher: WordHashes) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, first word of the window) for the rows of a text column: the best window of each pair."""
    hashes, at = hasher.of(column)
    if len(hashes) < 2 or not len(items.ids):
        return []
    starts, sizes = windows(items, hashes, at)
    if not len(starts):
        return []
    words = np.zeros(len(hashes), np.int64)
    known = member(hashes, items.vocabulary)
    words[known] = np.searchsorted(items.vocabulary, hashes[known]) + 1
    row = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.int32)
    ends = at[1:][row].astype(np.int64)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for first in range(0, len(starts), WALKING):
        start, size = starts[first : first + WALKING], sizes[first : first + WALKING]
        lengths = np.minimum(size, ends[start] - start)
        made = walk_keys(words, start, lengths, size)
        left = np.searchsorted(items.keys, made.ravel(), "left")
        times = np.searchsorted(items.keys, made.ravel(), "right") - left
        hits = np.flatnonzero(times)
        window = np.repeat(hits // made.shape[1], times[hits])
        run = np.arange(times[hits].sum()) - np.repeat(np.cumsum(times[hits]) - times[hits], times[hits])
        owner = items.owners[np.repeat(left[hits], times[hits]) + run]
        code = np.unique(window * len(items.ids) + owner)
        window, owner = code // len(items.ids), code % len(items.ids)
        same = items.sizes[owner] == size[window]
        window, owner = window[same], owner[same]
        for chunk in range(0, len(window), WALKING):
            w, o = window[chunk : chunk + WALKING], owner[chunk : chunk + WALKING]
            found = edits(words, start[w], lengths[w], items.words, items.starts[o], items.sizes[o])
            for i in np.flatnonzero(found <= limit(items.sizes[o])).tolist():
                begin = int(start[w[i]])
                pair = int(row[begin]), int(o[i])
                value = int(found[i]), begin - int(at[pair[0]])
                if pair not in best or value < best[pair]:
                    best[pair] = value
    return [(r, o, e, s) for (r, o), (e, s) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, key: str, text: str, least_words: int, most_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark block by block; each block that reaches the driver holds about ``most_words`` words."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    for row in rows.filter("text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        ids.append(NO_ID if row["id"] is None else row["id"])
        texts.append(row["text"])
        held += len(row["text"]) // 4
        if held >= most_words:
            yield build_items(ids, texts, least_words)
            ids, texts, held = [], [], 0
    if ids:
        yield build_items(ids, texts, least_words)


LEAKS = "doc_id long, item_id long, edits int, item_words int, position int"


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``doc_id, item_id, edits, item_words, position`` of every contaminated pair."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for block in item_blocks(benchmark, item_key, item_text, least_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hasher = shared.value, WordHashes(punctuation=True)
            for batch in slices(batches, 1):
                found = find(items, batch.column(1), hasher)
                ids = batch.column(0).take(pa.array([r for r, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([None if items.ids[o] == NO_ID else int(items.ids[o]) for _, o, *_ in found], pa.int64()),
                     pa.array([e for *_, e, _ in found], pa.int32()),
                     pa.array([int(items.sizes[o]) for _, o, *_ in found], pa.int32()),
                     pa.array([s for *_, s in found], pa.int32())],
                    schema=arrow_schema(LEAKS),
                )

        out = out.union(rows.mapInArrow(run, LEAKS))
    return out


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The rows of ``documents``, all columns, that no item contaminates; decided in the scan, without a join."""
    spark: SparkSession = documents.sparkSession
    position = documents.columns.index(text)
    for block in item_blocks(benchmark, item_key, item_text, least_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = WordHashes(punctuation=True)
            for batch in slices(batches, position):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in find(shared.value, batch.column(position), hasher)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
