"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers, ``floor(scale * x)``. They are dealt into groups by a coarse order (the dominant
component, then a hash of the id), for which they are only counted; inside a group they lie in blocks of consecutive
vectors. A block keeps the largest and the smallest value of each component, so ``sum(max(q_d * high_d, q_d * low_d))``
bounds every score in it. Per query the blocks of a group are visited by falling bound and scored through the block's
forward index (its integer matrix) until the next bound falls below the k-th score found; equal bounds are still scored,
so ties are decided exactly. The queries of a task make 1, 2, 4, ... visits a round, and a block is scored in one product
of matrices for all queries that visit it in the round.

Queries and groups meet in a grid: every query chunk is dealt once to every group, so each task holds one group and one
band of queries, both bounded, and nothing passes through the driver. Per task and query at most k rows come out; a window
over them takes the best k.

Defined results
* vectors that are null, empty, or hold null or non-finite components take no part; null ids take no part;
* only vectors with the query's number of components are compared;
* repeated ids: the smallest vector of an id stands for it; ties go to the smaller id;
* fewer than k candidates: all of them; an empty table: no rows; extra columns are not read;
* sums that leave the exact range of floats are computed in doubles, then in 64-bit integers, and where even these could
  overflow in unbounded ones; a score that a ``long`` cannot hold raises ``ScoreOverflow``, nothing is clipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tontine.llm.arrowtools import arrow_schema
from tontine.sources.shared import spool

SCALE = 256
K = 5
BLOCK = 64
#: Rows of a group and queries of a band: what one task holds.
GROUP_ROWS = 8192
BAND_QUERIES = 8192
#: Tasks of the grid; more cells than that share them.
MOST_TASKS = 1 << 14
#: Scores of a group that wait for a sort.
WAITING = 1 << 20
EXACT_SINGLE = float(1 << 24)
EXACT = float(1 << 53)
LONG = float(1 << 63)


class ScoreOverflow(OverflowError):
    """A score does not fit 64 bits."""


def sound_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v, dim, code`` of the rows that take part, one per id; vectors travel as they are stored."""
    value = F.col(vector)
    # NaN is above infinity and nulls are not seen by the two ends of an array.
    high, low = F.array_max(value).cast("double"), F.array_min(value).cast("double")
    sound = (high < float("inf")) & (low > float("-inf")) & F.forall(value, lambda x: x.isNotNull())
    rows = (
        vectors.filter(F.col(key).isNotNull() & sound)
        .select(F.col(key).cast("long").alias("id"), value.alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )
    high, low = F.array_max("v"), F.array_min("v")
    code = F.when(high.cast("double") >= -low.cast("double"), F.array_position("v", high)).otherwise(-F.array_position("v", low))
    return rows.select("id", "v", F.size("v").alias("dim"), code.cast("int").alias("code"))


def coarse_counts(rows: DataFrame, is_query: Column) -> DataFrame:
    """Rows and queries of every dimension and code, and the rows before them in the coarse order."""
    counts = rows.groupBy("dim", "code").agg(F.count("*").alias("n"), F.count_if(is_query).alias("wanted"))
    return counts.withColumn("before", F.sum("n").over(Window.orderBy("dim", "code")) - F.col("n"))


def in_groups(rows: DataFrame, counts: DataFrame, group_rows: int, groups: int) -> DataFrame:
    """The rows with their group; inside a code they go by a hash of the id, so that no row has to be sorted."""
    share = (F.hash("id") + (1 << 31)) / float(1 << 32)
    group = F.floor((F.col("before") + F.col("n") * share) / group_rows)
    return rows.join(counts, ["dim", "code"]).withColumn("group", F.least(group, F.lit(groups - 1)).cast("int"))


def quantised(column: pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    """Matrix of whole numbers, still as doubles, of the vectors of a column."""
    return np.floor(pc.list_flatten(column).to_numpy().astype(np.float64).reshape(-1, dim) * scale)


def whole(matrix: np.ndarray, most: float) -> np.ndarray:
    """The matrix in a kind of number that holds sums up to ``most`` exactly."""
    if most < EXACT:
        return matrix.astype(np.float32) if most < EXACT_SINGLE else matrix
    return matrix.astype(np.int64) if most < LONG / 2 else np.frompyfunc(int, 1, 1)(matrix)


def fitting(scores: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Unbounded scores as 64-bit integers; those of a query with itself do not count and become 0."""
    scores = np.where(others, scores, 0)
    if np.abs(scores).max() >= 1 << 63:
        raise ScoreOverflow("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def block_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Upper bound of every (query, block): positive components meet the highs, negative ones the lows."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Ranking:
    """The best k rows of each query; what is offered waits until a round or ``WAITING`` scores are together."""

    def __init__(self, queries: int, k: int, kind: np.dtype):
        self.k, self.waiting = k, 0
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind))]
        #: Score and id of the k-th of each query, which the next must beat.
        self.last_score = np.full(queries, -np.inf if kind.kind == "f" else np.iinfo(kind).min, kind)
        self.last_id = np.full(queries, np.iinfo(np.int64).max)

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        last = self.last_score[query]
        better = (score > last) | (score == last) & (ids <= self.last_id[query])
        self.parts.append((query[better], ids[better], score[better]))
        self.waiting += int(better.sum())
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k so far (query, id, score), ordered by query, falling score and id."""
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept, kth = rank < self.k, rank == self.k - 1
        self.last_score[query[kth]], self.last_id[query[kth]] = score[kth], ids[kth]
        self.parts, self.waiting = [(query[kept], ids[kept], score[kept])], 0
        return self.parts[0]


def search_group(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int):
    """Best k of one group for each query: arrays (query id, id, score)."""
    starts = np.arange(0, len(ids), block)
    low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
    bounds = block_bounds(low, high, queries)
    turns = np.argsort(-bounds, axis=1, kind="stable")
    falling = np.take_along_axis(bounds, turns, axis=1)
    best = Ranking(len(queries), k, np.dtype(np.int64) if rows.dtype == object else rows.dtype)
    done = 0
    while done < len(starts):
        best.settle()
        step = slice(done, 2 * done + 1)
        due = np.zeros((len(starts), len(queries)), bool)
        np.put_along_axis(due, turns[:, step].T, (falling[:, step] >= best.last_score[:, None]).T, axis=0)
        if not due.any():
            break
        for b in np.flatnonzero(due.any(axis=1)):
            mine, part = np.flatnonzero(due[b]), slice(starts[b], starts[b] + block)
            score = rows[part] @ queries[mine].T
            if score.dtype == object:
                score = fitting(score, ids[part, None] != query_ids[mine])
            if not done and len(score) > k:
                # Of the k + 1 best of a first block one may be the query itself; k others reach the last of them.
                best.last_score[mine] = np.partition(score, -k - 1, axis=0)[-k - 1]
            gains = score.max(axis=0) >= best.last_score[mine]
            mine, score = mine[gains], score[:, gains]
            row, at = np.nonzero(score >= best.last_score[mine])
            apart = ids[part][row] != query_ids[mine[at]]
            best.offer(mine[at][apart], ids[part][row][apart], score[row, at][apart])
        done = step.stop
    query, found, score = best.settle()
    return query_ids[query], found, score


FOUND = "query_id long, id long, score long"


def top_k(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    group_rows: int = GROUP_ROWS,
    band_queries: int = BAND_QUERIES,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query`` (a condition on column ``id``) the k best."""
    rows = spool(sound_vectors(vectors, key, vector), "vectors")
    counts = spool(coarse_counts(rows, is_query), "vector-counts")
    total, wanted = (n or 0 for n in counts.agg(F.sum("n"), F.sum("wanted")).first())
    groups, bands = max(1, -(-total // group_rows)), max(1, -(-wanted // band_queries))
    every_band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    band = F.pmod(F.xxhash64("id"), F.lit(bands)).cast("int")
    cell = (F.col("group") * bands + F.col("band")).alias("cell")
    # Groups are consecutive ranges of the coarse order, which makes block bounds tight.
    left = in_groups(rows, counts, group_rows, groups).withColumn("band", every_band).select(cell, "dim", "code", "id", "v")
    asked = rows.filter(is_query).withColumns({"band": band, "group": every_group})
    right = asked.select(cell, *(F.col(name).alias(name) for name in ("dim", "id", "v")))  # columns of its own for the cogroup
    # The work of a cell goes by its products and not by its bytes, so each is a task of its own.
    left, right = (side.repartitionById(min(groups * bands, MOST_TASKS), "cell") for side in (left, right))

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [arrow_schema(FOUND).empty_table()]
        for dim in pc.unique(asked["dim"]).to_pylist() if candidates.num_rows and asked.num_rows else ():
            mine, theirs = (x.filter(pc.field("dim") == dim) for x in (candidates, asked))
            if not mine.num_rows:
                continue
            mine = mine.sort_by([("code", "ascending"), ("id", "ascending")])
            matrix, query = quantised(mine["v"], dim, scale), quantised(theirs["v"], dim, scale)
            most = float(np.abs(matrix).max()) * float(np.abs(query).max()) * dim
            found = search_group(mine["id"].to_numpy(), whole(matrix, most), theirs["id"].to_numpy(), whole(query, most), k, block)
            parts.append(pa.table([found[0], found[1], found[2].astype(np.int64)], schema=arrow_schema(FOUND)))
        return pa.concat_tables(parts)

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (
        found.withColumn("rank", rank).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
