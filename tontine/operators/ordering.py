"""Global order without a global sort.

Row positions, exact-size samples, exact quantiles and rank statistics all need the
position of a row in a total order. An unpartitioned window would pull the table into
one task; the operators here split the order into buckets that any task can compute for
a row on its own, count the buckets (a small table of bounded size) and let each bucket
be ordered separately.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tontine.functions.scalars import doubles
from tontine.functions.hashing import hash_bucket, seeded_md5


def _bucket_sizes(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per hash bucket with the rows before it: at most N_BUCKETS rows per stratum."""
    sizes = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*(strata or [F.lit(0)]))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *strata,
        "_bucket",
        "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"),
    )


def _with_bucket(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_hash", seeded_md5(key, seed)).withColumn("_bucket", hash_bucket("_hash"))


def hash_index(
    df: DataFrame,
    key: str,
    seed: int,
    out: str = "event_index",
    total: str | None = None,
    strata: Sequence[str] = (),
) -> DataFrame:
    """0-based position of each row in the seeded hash order of a unique key.

    Keys are unique, so the hash spreads rows evenly over the buckets whatever the data
    looks like; the broadcast table has at most N_BUCKETS rows per stratum.
    """
    keyed = _with_bucket(df, key, seed)
    offsets = _bucket_sizes(keyed, strata)
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    placed = keyed.withColumn("_rank", F.row_number().over(inside)).join(
        F.broadcast(offsets), [*strata, "_bucket"]
    )
    columns = [*df.columns, (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias(out)]
    if total:
        columns.append(F.col("_total").alias(total))
    return placed.select(*columns)


def hash_limits(df: DataFrame, key: str, seed: int, starts: Callable[[Column], Column]) -> list[tuple[int, str, object]]:
    """``position, hash, key`` of the rows at the positions ``starts(rows)`` (a short array) of the seeded hash order.

    Only buckets that hold such a position are ranked. Positions behind the last row have no limit.
    """
    keyed = _with_bucket(df.select(key), key, seed)
    sizes = _bucket_sizes(keyed, ())
    inside = lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_rows"))
    asked = sizes.select("_bucket", "_before", F.explode(F.filter(starts(F.col("_total")), inside)).alias("_at"))
    order = Window.partitionBy("_bucket").orderBy("_hash", key)
    # One row per position wanted.
    ranked = keyed.join(F.broadcast(asked.select("_bucket").distinct()), "_bucket").withColumn("_rank", F.row_number().over(order) - 1)
    found = ranked.join(F.broadcast(asked), "_bucket").filter(F.col("_rank") + F.col("_before") == F.col("_at"))
    return sorted((r["_at"], r["_hash"], r[key]) for r in found.select("_at", "_hash", key).collect())


def hash_sample_flag(
    df: DataFrame,
    key: str,
    seed: int,
    size: Callable[[Column], Column],
    out: str,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Mark exactly ``size(rows)`` rows per stratum: the first ones in hash order.

    Only the one bucket per stratum that holds the cut is ranked, for the hash and key of the last row inside; every row
    compares itself with that, so the table is read once and no row of it is shuffled. ``size`` gets the stratum's row
    count and may look at other strata through a window.
    """
    keyed = df.withColumn("_hash", seeded_md5(key, seed))
    by = [*strata] or ["_all"]
    if strata:
        keyed = keyed.dropna(subset=by)
    else:
        keyed = keyed.withColumn("_all", F.lit(0))
    bucketed = keyed.select(*by, key, "_hash").withColumn("_bucket", hash_bucket("_hash"))
    sizes = _bucket_sizes(bucketed, by).withColumn("_want", size(F.col("_total")))
    at = F.least(F.col("_want"), F.col("_total")) - F.col("_before")
    cuts = sizes.select(*by, "_bucket", at.alias("_at"), "_rows").filter((F.col("_at") > 0) & (F.col("_at") <= F.col("_rows")))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    # One row per stratum.
    last = (
        bucketed.join(F.broadcast(cuts), [*by, "_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_at"))
        .select(*by, F.col("_hash").alias("_last_hash"), F.col(key).alias("_last_key"))
    )
    within = (F.col("_hash") < F.col("_last_hash")) | ((F.col("_hash") == F.col("_last_hash")) & (F.col(key) <= F.col("_last_key")))
    flagged = keyed.join(F.broadcast(last), by, "left")
    return flagged.select(*df.columns, F.coalesce(within, F.lit(False)).alias(out))


def hash_sample(
    df: DataFrame,
    key: str,
    seed: int,
    size: Callable[[Column], Column],
    strata: Sequence[str] = (),
) -> DataFrame:
    """Exact-size sample without replacement, repeatable for a seed and a key set."""
    flagged = hash_sample_flag(df, key, seed, size, "_sampled", strata)
    return flagged.filter("_sampled").drop("_sampled")


#: A range holds about so many rows; a table is cut into so many ranges at most at a time.
RANGE_ROWS, MOST_RANGES = 1 << 18, 4096


def range_count(rows: int, range_rows: int = RANGE_ROWS) -> int:
    """Ranges that a table of ``rows`` rows is cut into."""
    return min(MOST_RANGES, max(1, -(-rows // range_rows)))


def _sketch(value: str, buckets: int) -> Column:
    shares = doubles(i / buckets for i in range(1, buckets))
    return F.expr(f"percentile_approx({value}, {shares}, {buckets * 10})")


def _ranged(df: DataFrame, cuts: dict[str, list[float]]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the range of each column's value, by binary search in the JVM, as one number per range.

    Cuts are values of the data and each is a range of its own, so a heavy value never shares one: values between the
    cuts ``i - 1`` and ``i`` have the number ``2 i``, those equal to cut ``i`` the number ``2 i + 1``.
    """
    searched = {c: edges for c, edges in cuts.items() if edges}
    numbers = {c: F.lit(0) for c in cuts}
    if searched:
        names = {c: f"_range_{i}" for i, c in enumerate(searched)}
        df = Bucketizer(
            splitsArray=[[float("-inf"), *edges, float("inf")] for edges in searched.values()],
            inputCols=list(searched),
            outputCols=list(names.values()),
            handleInvalid="keep",
        ).transform(df)
        for c, edges in searched.items():
            place = F.col(names[c]).cast("int")  # cut i opens the range i + 1
            at_cut = (place > 0) & (F.col(c) == F.get(F.expr(doubles(edges)), place - 1))
            numbers[c] = F.when(at_cut, 2 * place - 1).otherwise(2 * place)
    return df, numbers


class _Interval(NamedTuple):
    """Values strictly between two cuts (null: no limit) that hold wanted ranks; ``before`` rows lie below them."""

    low: float | None
    high: float | None
    before: int
    rows: int
    ranks: tuple[int, ...]

    def holds(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > self.low)
        return inside if self.high is None else inside & (value < self.high)


def _narrowed(values: DataFrame, open_: dict[str, list[_Interval]], cut_count: Callable[[_Interval], int]):
    """One round: intervals are cut by a sketch and counted; only sub-ranges that hold wanted ranks stay open.

    Returns what stays open and the values found. The driver gets the cuts and one row per range.
    """
    tasks = [(c, i, part) for c, parts in open_.items() for i, part in enumerate(parts)]
    sketched = values.agg(
        *(_sketch_of(part.holds(F.col(c)), c, cut_count(part)).alias(f"{t}") for t, (c, _, part) in enumerate(tasks))
    ).first()
    cuts: dict[str, set[float]] = {c: set() for c in open_}
    for t, (c, _, part) in enumerate(tasks):
        cuts[c] |= {*(sketched[t] or []), *(x for x in (part.low, part.high) if x is not None)}
    edges = {c: sorted(found) for c, found in cuts.items()}
    ranged, numbers = _ranged(values, edges)
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), numbers[c].alias("range"), F.col(c).alias("value")) for c in edges))
    counted = (
        ranged.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "range")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    per: dict[str, dict[int, tuple[int, float, float]]] = {c: {} for c in edges}
    for r in counted.collect():
        per[r["feature"]][r["range"]] = (r["n"], r["least"], r["most"])
    still: dict[str, list[_Interval]] = {}
    values_at: dict[tuple[str, int], float] = {}
    for c, parts in open_.items():
        limits = edges[c]
        for part in parts:
            first = 0 if part.low is None else 2 * limits.index(part.low) + 2
            last = 2 * len(limits) if part.high is None else 2 * limits.index(part.high)
            before = part.before
            for number in range(first, last + 1):
                n, least, most = per[c].get(number, (0, 0.0, 0.0))
                ranks = tuple(r for r in part.ranks if before <= r < before + n)
                if ranks and least == most:
                    values_at.update({(c, r): least for r in ranks})
                elif ranks:
                    low = limits[number // 2 - 1] if number >= 2 else None
                    high = limits[number // 2] if number // 2 < len(limits) else None
                    still.setdefault(c, []).append(_Interval(low, high, before, n, ranks))
                before += n
    return still, values_at


def _sketch_of(inside: Column, column: str, ranges: int) -> Column:
    shares = F.expr(doubles(i / max(ranges, 2) for i in range(1, max(ranges, 2))))
    return F.percentile_approx(F.when(inside, F.col(column)), shares, max(ranges, 2) * 10)


def _located(values: DataFrame, open_: dict[str, list[_Interval]]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks of small intervals: only their rows are shuffled, repeated values as one row per task."""
    wanted = [(f"{c}/{i}", c, part) for c, parts in open_.items() for i, part in enumerate(parts)]
    if not wanted:
        return {}
    # The intervals of a column do not overlap: a value lies in one of them at most, so a row is one cell per column.
    cells = []
    for c, parts in open_.items():
        inside = F.coalesce(*(F.when(part.holds(F.col(c)), F.lit(f"{c}/{i}")) for i, part in enumerate(parts)))
        cells.append(F.struct(inside.alias("interval"), F.col(c).alias("value")))
    counts = (
        values.select(F.inline(F.array(*cells))).filter(F.col("interval").isNotNull())
        .groupBy("interval", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    asked = values.sparkSession.createDataFrame(
        [(name, part.before, list(part.ranks)) for name, _, part in wanted], "interval string, before long, ranks array<long>"
    )
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("interval").orderBy("value"))
    located = (
        counts.join(F.broadcast(asked), "interval")  # one row per interval
        .withColumn("upto", upto)
        .withColumn("hit", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
        .select("interval", "value", F.explode("hit").alias("rank"))
    )
    column = {name: c for name, c, _ in wanted}
    return {(column[r["interval"]], r["rank"]): r["value"] for r in located.collect()}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    buckets: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Linearly interpolated exact quantiles, one row per column; a column without values has none.

    Output: ``feature, n_values, quantiles ARRAY<DOUBLE>`` in the order of ``shares``.
    The order is narrowed down: a table is cut into ranges of about half of ``range_rows`` (``buckets`` asks for a number of
    them), so that what the sketch errs by does not call for another round; ranges are counted map-side, and what holds a wanted rank is cut again until it has at most ``range_rows`` rows. Only these
    rows are shuffled, at most two ranges per share however large the table is, and a heavy value is found by counting.
    """
    endless = (float("-inf"), float("inf"))
    values = df.select(*((F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns))
    values = values.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns))
    counts = values.agg(
        *(F.struct(F.count(c).alias("n"), *(F.count_if(F.col(c) == x).alias(f"n{x}") for x in endless)).alias(c) for c in columns)
    ).first()
    values = values.select(*(F.when(~F.col(c).isin(*endless), F.col(c)).alias(c) for c in columns))
    totals, open_ = {c: counts[c][0] for c in columns}, {}
    found: dict[tuple[str, int], float] = {}
    for c, (total, low, high) in ((c, counts[c]) for c in columns):
        spots = [int(np.floor((total - 1) * share)) for share in shares] if total else []
        ranks = sorted({min(x + more, total - 1) for x in spots for more in (0, 1)})
        found.update({(c, r): endless[r >= low] for r in ranks if r < low or r >= total - high})
        if total > low + high:
            open_[c] = [_Interval(None, None, low, total - low - high, tuple(r for r in ranks if (c, r) not in found))]
    forced = buckets
    while any(part.rows > range_rows or forced for parts in open_.values() for part in parts):
        large = {c: [p for p in parts if p.rows > range_rows or forced] for c, parts in open_.items()}
        small = {c: [p for p in parts if not (p.rows > range_rows or forced)] for c, parts in open_.items()}
        still, more = _narrowed(values, {c: p for c, p in large.items() if p}, lambda p: forced or range_count(p.rows, -(-range_rows // 2)))
        found.update(more)
        open_ = {c: small.get(c, []) + still.get(c, []) for c in open_}
        forced = None
    found.update(_located(values, {c: parts for c, parts in open_.items() if parts}))

    def quantile(c: str, share: float) -> float:
        spot = (totals[c] - 1) * share
        low = int(np.floor(spot))
        step, a, b = spot - low, found[c, low], found[c, min(low + 1, totals[c] - 1)]
        if step == 0.0 or a == b:
            return a
        return b - (b - a) * (1.0 - step) if step >= 0.5 else a + (b - a) * step

    rows = [(c, total, [quantile(c, share) for share in shares]) for c, total in totals.items() if total]
    return df.sparkSession.createDataFrame(rows, "feature string, n_values bigint, quantiles array<double>")


def decile_shares(bins: int) -> list[float]:
    """``bins + 1`` evenly spaced shares as IEEE doubles (0.30000000000000004 included)."""
    return [float(share) for share in np.linspace(0.0, 1.0, bins + 1)]


def rank_statistic(df: DataFrame, score: str, positive: Column, buckets: int | None = None) -> DataFrame:
    """Sums behind the exact, tie-aware Mann-Whitney statistic: ``u, positives, negatives``, one row.

    Equal scores are merged before any shuffle; distinct scores are split into score ranges
    whose number follows the row count, each ordered on its own, and the ranges are chained
    by their totals. The range limits come from a sketch that is run when the plan is built.
    """
    sums = rank_statistics(df, (), score, positive, buckets)
    return sums.agg(
        F.sum("u").alias("u"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
    )


def rank_statistics(
    df: DataFrame, by: Sequence[str], score: str, positive: Column, buckets: int | None = None, times: str | None = None
) -> DataFrame:
    """The sums of ``rank_statistic`` per value of ``by``; a row counts ``times`` times. All groups share the ranges."""
    count = F.col(times).cast("bigint") if times else F.lit(1).cast("bigint")
    usable = df.select(*by, (F.col(score).cast("double") + F.lit(0.0)).alias("score"), positive.alias("positive"), count.alias("times"))
    ranges = buckets or range_count(usable.count())
    cuts: list[float] = []
    if ranges > 1:
        cuts = sorted({x for x in usable.agg(_sketch("score", ranges).alias("cuts")).first()[0] or [] if np.isfinite(x)})
    per_score = usable.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("positive"), F.col("times")).otherwise(0)).alias("pos"),
        F.sum(F.when(~F.col("positive"), F.col("times")).otherwise(0)).alias("neg"),
    )
    ranged, numbers = _ranged(per_score, {"score": cuts})
    lower = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        ranged.withColumn("bucket", F.coalesce(numbers["score"], F.lit(0)))
        .withColumn("neg_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
        .groupBy(*by, "bucket")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))).alias("u"),
        )
    )
    # At most two rows per cut and group.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        summed.withColumn("neg_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum(F.col("u") + F.col("pos") * F.col("neg_before").cast("double")).alias("u"),
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
        )
    )
