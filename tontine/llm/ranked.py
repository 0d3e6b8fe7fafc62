"""Ranked lexical search by dense blocked matrix products.

Items are dealt to blocks of bounded vocabulary. For a block, every document is cut into terms once and kept as a narrow
posting row (terms of the block's vocabulary by number, with their counts); numbers of documents and terms and the document
frequencies are folded inside the tasks from these rows. Then a task lays the postings of some documents out as a dense
tile of impacts, only with the vocabulary that occurs in it, and multiplies it by the items' term counts with one float64
matrix product. Impacts are integers. A product runs over so few terms that no partial sum can reach 2^53, so it is exact,
and products of several vocabulary tiles are added in 64-bit integers. Per tile, scores that reach both the tile's k-th and
the task's k-th best score of an item stay, ties included; ``k`` rows per item leave a task and a window ranks them.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased.

Defined results
* null text, or a text without terms: no document of the statistics, never listed;
* null ``doc_id``: counts in the statistics, never listed; repeated rows are documents of their own, ties go to the smaller
  ``doc_id`` (rows of one id and score are interchangeable);
* items: the rows of an id, null included, are one item with their smallest text; an item without terms, or without a
  document that shares one, has no rows; fewer than ``k`` documents with a score above 0: all of them;
* no documents or no items: no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tontine.llm.arrowtools import LOWER_ASCII, arrow_schema, encoded, slices
from tontine.sources.shared import spool

K = 20
#: Items times distinct terms of a block of items (one item at least): the matrix that is broadcast, 8 bytes each.
BLOCK_CELLS = 1 << 23
#: Documents, vocabulary terms and items of one matrix product.
TILE_DOCUMENTS, TILE_TERMS, TILE_ITEMS = 512, 1024, 2048
EXACT = 1 << 53
#: Largest value of ``(1000000000*tf) div (1000*tf+12*m)``.
MOST_IMPACT = 1_000_000

POSTING = "doc_id long, n long, terms array<int>, counts array<int>"
COUNTED = "term int, documents long, total long"
FOUND = "item int, doc_id long, score long"

#: Every byte that separates terms to a space, A-Z to a-z, all else unchanged.
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER_ASCII)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.groupBy(F.col(item).alias("item_id")).agg(F.min(F.col(text).cast("string")).alias("text"))


def item_blocks(items: DataFrame, most_cells: int = BLOCK_CELLS) -> Iterator[list[tuple]]:
    """Blocks of ``(item id, term counts)`` of bounded size, read one by one."""
    block, known = [], set()
    for row in items.orderBy("item_id").toLocalIterator():
        counts = Counter(terms_of(row.text.encode() if row.text else None))
        if not counts:
            continue
        if block and (len(block) + 1) * (len(known) + len(counts.keys() - known)) > most_cells:
            yield block
            block, known = [], set()
        block.append((row.item_id, counts))
        known |= counts.keys()
    if block:
        yield block


def postings(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document with terms: its length, and those of its terms that the vocabulary holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 1):
            ids, lengths, numbers, counts, ends = [], [], [], [], [0]
            for doc_id, body in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                words = terms_of(body)
                if not words:
                    continue
                for word, count in Counter(words).items():
                    number = known.get(word)
                    if number is not None:
                        numbers.append(number)
                        counts.append(count)
                ids.append(doc_id)
                lengths.append(len(words))
                ends.append(len(numbers))
            offsets = pa.array(ends, pa.int32())
            columns = [
                pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(POSTING))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(index, POSTING)


def statistics(posted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms and document frequencies (by term number) over all postings; ``size + 1`` rows reach the driver."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, held = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            documents += batch.num_rows
            total += int(batch.column(0).to_numpy().sum())
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        kept = np.flatnonzero(held)
        columns = [np.append(kept, -1).astype(np.int32), np.append(held[kept], documents), np.append(np.zeros(len(kept), np.int64), total)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=arrow_schema(COUNTED))

    counted = posted.select("n", "terms").mapInArrow(fold, COUNTED).groupBy("term").agg(F.sum("documents"), F.sum("total"))
    documents, total, frequency = 0, 0, np.zeros(size, np.int64)
    for term, held, length in counted.collect():
        if term < 0:
            documents, total = held, length
        else:
            frequency[term] = held
    return documents, total, frequency


def term_weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``(1000000000*tf) div (1000*tf+12*m)`` for postings, with the length of each one's document."""
    m = 75 + (25 * lengths * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def vocabulary_cuts(asked: np.ndarray, weight: np.ndarray, most: int = TILE_TERMS) -> list[int]:
    """Where vocabulary tiles begin and end: no item's partial sum over a tile of several terms can reach 2^53."""
    heaviest = asked.max(axis=0).astype(np.int64) * weight * MOST_IMPACT
    cuts, held = [0], 0
    for at, value in enumerate(heaviest.tolist()):
        if at > cuts[-1] and (held + value >= EXACT or at - cuts[-1] >= most):
            cuts.append(at)
            held = 0
        held += value
    return [*cuts, len(weight)]


def tile_scores(asked: np.ndarray, weight: np.ndarray, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
    """Exact scores (items x documents) of one document tile; ``rows``: term of each posting, ``columns``: its document."""
    scores = np.zeros((len(asked), width), np.int64)
    present = np.unique(rows)
    if not len(present):
        return scores
    place = np.searchsorted(present, rows)
    order = np.argsort(place, kind="stable")
    place, columns, impact = place[order], columns[order], impact[order]
    asked, weight = asked[:, present], weight[present]
    cuts = vocabulary_cuts(asked, weight)
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(*np.searchsorted(place, [first, last]))
        value = impact[part] * weight[place[part]]
        if last == first + 1:  # one term, however often an item repeats it
            scores[:, columns[part]] += asked[:, [first]].astype(np.int64) * value
            continue
        tile = np.zeros((last - first, width))
        tile[place[part] - first, columns[part]] = value
        scores += (asked[:, first:last] @ tile).astype(np.int64)
    return scores


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every item by falling score, then by id."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
    keep = rank < k
    return item[keep], doc[keep], score[keep]


def search_block(posted: DataFrame, asked: np.ndarray, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best documents of each task for every item (by row number in ``asked``)."""
    shared = posted.sparkSession.sparkContext.broadcast((asked, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        floor = np.ones(len(asked), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCUMENTS):
                tile = batch.slice(start, TILE_DOCUMENTS)
                ids, lengths = tile.column(0).to_numpy(), tile.column(1).to_numpy()
                sizes = np.diff(tile.column(2).offsets.to_numpy())
                columns = np.repeat(np.arange(len(ids)), sizes)
                rows = tile.column(2).flatten().to_numpy()
                impact = impacts(tile.column(3).flatten().to_numpy().astype(np.int64), lengths[columns], documents, total)
                for first in range(0, len(asked), TILE_ITEMS):
                    some = slice(first, first + TILE_ITEMS)
                    scores = tile_scores(asked[some], weight, rows, columns, impact, len(ids))
                    least = floor[some]
                    if len(ids) > k:
                        least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                    item, at = np.nonzero(scores >= least[:, None])
                    if len(item):
                        new = item + first, ids[at], scores[item, at]
                        best = best_of(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
                        full = np.flatnonzero(np.bincount(best[0], minlength=len(asked)) >= k)
                        ends = np.searchsorted(best[0], full, side="right") - 1
                        floor[full] = np.maximum(floor[full], best[2][ends])
        arrays = [pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])]
        yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema(FOUND))

    return posted.filter((F.size("terms") > 0) & F.col("doc_id").isNotNull()).mapInArrow(score, FOUND)


def search(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", k: int = K, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark: SparkSession = docs.sparkSession
    kind = benchmark.schema[item].dataType.simpleString()
    results = []
    for block in item_blocks(items_of(benchmark, item, item_text), block_cells):
        vocabulary = {term: at for at, term in enumerate(sorted({t for _, counts in block for t in counts}))}
        asked = np.zeros((len(block), len(vocabulary)))
        for at, (_, counts) in enumerate(block):
            for term, count in counts.items():
                asked[at, vocabulary[term]] = count
        posted = spool(postings(docs, key, text, vocabulary), "postings")
        documents, total, frequency = statistics(posted, len(vocabulary))
        if not documents:
            continue
        found = search_block(posted, asked, term_weights(documents, frequency), documents, total, k)
        names = spark.createDataFrame([(at, name) for at, (name, _) in enumerate(block)], f"item int, item_id {kind}")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
