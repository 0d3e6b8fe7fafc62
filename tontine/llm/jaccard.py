"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds 64-bit fingerprints of its distinct word shingles. Documents with the same set are one node; a
link joins two nodes with ``100 * |x & y| >= 75 * |x | y|`` (threshold as a parameter).

Candidates. Tokens are ordered rare first, then by falling rarity of the frequent ones, else by fingerprint. Sizes fall
into narrow bands. For a partner of a given band the overlap is at least ``a = ceil(t / (1 + t) * (|x| + low))``, and two
linked sets share ``l`` tokens at least among their first ``|x| - a + l``:

* every node is indexed under the rare tokens of its longest prefix, one token each;
* for each partner band in which the 1-prefix does not consist of rare tokens alone, the prefix is extended by
  ``l - 1 = m`` tokens and the node is indexed, for this pair of bands, under combinations of two frequent tokens.
  Frequent tokens fall into ``m`` classes by fingerprint and only tokens of one class are combined: of ``m + 1`` shared
  frequent tokens two lie in one class, so the pair is found, while the number of combinations grows with the prefix and
  not with its square. ``m`` depends on the two bands; where the shorter prefix is tiny, single tokens take the place of
  combinations.

The bands matter in groups of near copies: a copy with too many tokens of its own is known to link with nothing through
the group's common tokens, without a comparison with each of its members.

A token is frequent if it is frequent in some task's share of the documents, or if all documents together hold it
``OFTEN`` times; the latter is counted for the tokens with low fingerprints, which are those that prefixes reach. This only
steers the order: any split into classes gives the same links.

Verification. Hot keys are met by stars: the nodes of a key are compared with its ``LEADERS`` most central members only.
Then components are formed, and what is left, nodes of one key in different components that are no leaders, is compared
pair by pair. So every candidate pair is either verified or connected already, and no group is expanded into all pairs.
Pairs first meet as sketches, token counts per bucket: the sum of the smaller counts bounds the overlap, so only pairs
that may link need their sets, and only those sets are read.

Defined results
* without words or text (null, empty, white space): no shingles, linked with nothing, component = own id;
* fewer words than a shingle: the whole sequence is the only shingle;
* null id: takes part; the component is the smallest id that is not null, null if there is none;
* repeated ids and rows: each row is answered; equal sets share a component;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tontine.llm.arrowtools import arrow_schema, mix64, slices
from tontine.llm.components import components
from tontine.llm.registry import unused
from tontine.llm.words import WordHashes
from tontine.sources.shared import spool

WORDS = 5
PERCENT = 75
#: A token is frequent if it occurs in this share of a task's documents (in two at least). A task may report
#: 1 / FREQUENT_SHARE tokens for each token of its mean document, so the table is bounded whatever the corpus.
FREQUENT_SHARE = 1 / 500
#: Counted over all documents: tokens whose fingerprint lies in the lowest share, by its top bits.
COUNTED_SHARE, COUNTED_BITS = 0.35, 40
OFTEN = 24
#: Most frequent tokens of either kind sent to the tasks (16 bytes each); beyond, the less frequent ones count as rare.
MOST_FREQUENT = 1 << 20
#: Most bits of the map of wanted nodes (32 MB).
MOST_BITS = 1 << 28
#: Members of a key that all others are compared with first.
LEADERS = 4
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def bands(most: int = 1 << 40) -> list[int]:
    """Lowest size of each band; bands are a twentieth wide, single sizes at the start."""
    lows = [1]
    while lows[-1] < most:
        lows.append(lows[-1] + max(1, lows[-1] // 20))
    return lows


class Fingerprints:
    """Word shingles of texts as sorted distinct 64-bit fingerprints, for a whole Arrow column at once.

    A shingle mixes the hashes of its words; nothing is computed word by word in Python.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.hasher = words, WordHashes()
        self.factors = [np.uint64(pow(MIX[0], i, 1 << 64) ^ MIX[1 + i % 4] | 1) for i in range(words)]

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """The set of every row; empty where there is no word."""
        hashes, at = self.hasher.of(column)
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - self.words + 1)
            mixed = np.zeros(n, np.uint64)
            for i, factor in enumerate(self.factors):
                mixed += hashes[i : i + n] * factor
            mixed = mix64(mixed)
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= self.words:
                    out.append(np.unique(mixed[a : b - self.words + 1]))
                else:
                    whole = np.full(min(1, b - a), np.uint64((b - a) * MIX[4] & (1 << 64) - 1), np.uint64)
                    for i in range(a, b):
                        whole += hashes[i] * self.factors[i - a]
                    out.append(mix64(whole))
        return out


def node_id(tokens: np.ndarray) -> int:
    """Name of a set: 63 bits of a digest over its sorted fingerprints."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


@dataclass(frozen=True)
class Frequent:
    """Frequent tokens: whole ones, and top bits of those with low fingerprints; sorted, with their counts."""

    tokens: np.ndarray
    counts_: np.ndarray
    tops: np.ndarray
    top_counts: np.ndarray

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """Count of each of the sorted tokens; 0: rare."""
        out = np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            at = np.searchsorted(self.tokens, tokens)
            at[at == len(self.tokens)] = 0
            out = np.where(self.tokens[at] == tokens, self.counts_[at], 0)
        if len(self.tops):
            top = tops_of(tokens)
            at = np.searchsorted(self.tops, top)
            at[at == len(self.tops)] = 0
            out[: len(top)] = np.maximum(out[: len(top)], np.where(self.tops[at] == top, self.top_counts[at], 0))
        return out


def tops_of(tokens: np.ndarray) -> np.ndarray:
    """Top bits of the counted ones among sorted tokens; they come first."""
    low = tokens[: np.searchsorted(tokens, np.uint64(int(COUNTED_SHARE * 2**64)))]
    return (low >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


class Prefixes:
    """Index keys of a set."""

    def __init__(self, percent: int, frequent: Frequent) -> None:
        self.percent, self.frequent = percent, frequent
        self.lows = bands()

    def overlap(self, n: int, m: int) -> int:
        """Least overlap of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def classes(self, band: int, other: int) -> int:
        """Classes of frequent tokens for a pair of bands; 0: frequent tokens stand alone."""
        low, high = sorted((self.lows[band], self.lows[other]))
        return max(0, (low - self.overlap(low, high) + 1) // 3) if low >= 8 else 0

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The index keys of a set, the side of each, and how many of the set's tokens are rare.

        A key made for two different bands joins the nodes of one band (side 0) with those of the other (side 1); under
        any other key (side -1) all nodes meet.
        """
        n, t = len(tokens), self.percent
        least = -(-t * n // 100)
        counts = self.frequent.counts(tokens)
        hit = counts > 0
        rare = tokens[~hit]
        out = [rare[: n - least + 1]]
        sides = [np.full(len(out[0]), -1, np.int32)]
        if len(rare) > n - least:
            return out[0], sides[0], len(rare)
        common = tokens[hit][np.argsort(counts[hit], kind="stable")]
        band = bisect_right(self.lows, n) - 1
        for other in range(bisect_right(self.lows, least) - 1, bisect_right(self.lows, n * 100 // t)):
            overlap = self.overlap(n, max(least, self.lows[other]))
            first = n - overlap + 1
            if first <= 0 or len(rare) >= first:
                continue
            m = self.classes(band, other)
            part = common[: first + m - len(rare)]
            tag = np.uint64(MIX[3] + (min(band, other) << 16) + max(band, other))
            with np.errstate(over="ignore"):
                side = -1 if band == other else int(band > other)
                if m == 0:
                    out.append(mix64(part + tag))
                    sides.append(np.full(len(part), side, np.int32))
                    continue
                group = mix64(part ^ np.uint64(MIX[2])) % np.uint64(m)
                order = np.argsort(group, kind="stable")
                left, right = [], []
                for members in np.split(part[order], np.flatnonzero(np.diff(group[order])) + 1):
                    members = np.sort(members)
                    i, j = np.triu_indices(len(members), 1)
                    left.append(members[i])
                    right.append(members[j])
                out.append(mix64(np.concatenate(left) * np.uint64(MIX[0]) ^ mix64(np.concatenate(right) + tag)))
                sides.append(np.full(len(out[-1]), side, np.int32))
        return np.concatenate(out), np.concatenate(sides), len(rare)


DOCS = "doc_id long, node long, n_shingles long, sketch binary, token long, local int"


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens per bucket, at most 255 each counts exactly; the number of buckets is a power of two near the set's size."""
    buckets = 1 << max(3, (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two sketches leave room for a link; an empty sketch always does."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a = a.reshape(-1, size).sum(0, dtype=np.int64)  # fold the longer one: buckets are the low bits of a token
    b = b.reshape(-1, size).sum(0, dtype=np.int64)
    return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * (n + m)


def read_sets(documents: DataFrame, key: str, text: str, words: int, share: float) -> DataFrame:
    """One pass: a row per document, and a row (``token`` not null) per token that is frequent in the task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, seen = Fingerprints(words), Counter(), 0
        pending: list[np.ndarray] = []

        def count() -> None:
            """Fold pending tokens; once in a while tokens too rare to reach the share are let go."""
            if pending:
                values, times = np.unique(np.concatenate(pending), return_counts=True)
                pending.clear()
                often = times >= 2
                counts.update(dict(zip(values[often].tolist(), times[often].tolist(), strict=True)))

        held = 0
        for batch in slices(batches, 1):
            ids, nodes, sizes, sketches = batch.column(0), [], [], []
            for tokens in prints.of(batch.column(1)):
                nodes.append(node_id(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                sketches.append(sketch(tokens) if len(tokens) else None)
                pending.append(tokens)
                held += len(tokens)
                seen += 1
                if held > 1 << 22:
                    count()
                    held = 0
            empty = pa.nulls(len(nodes))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), empty.cast(pa.int64()), empty.cast(pa.int32())],
                schema=arrow_schema(DOCS),
            )
        count()
        least = max(2, int(np.ceil(share * seen)))
        kept = {token: n for token, n in counts.items() if n >= least}
        if kept:
            none = pa.nulls(len(kept)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(len(kept), pa.binary()), pa.array(np.array(list(kept), np.uint64).view(np.int64)), pa.array(list(kept.values()), pa.int32())],
                schema=arrow_schema(DOCS),
            )

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, DOCS)


def often_held(documents: DataFrame, text: str, words: int, often: int, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Top bits of the counted tokens that ``often`` documents or more hold, with their counts.

    Every document is counted. Sums are folded map-side; per counted token some eight bytes are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(words)
        for batch in slices(batches, 0):
            tops = [tops_of(tokens) for tokens in prints.of(batch.column(0))]
            if tops:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tops))], names=["top"])

    counted = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "top long")
    table = (
        counted.groupBy("top").agg(F.count("*").alias("n")).filter(F.col("n") >= often)
        .orderBy(F.desc("n"), "top").limit(most).toPandas().sort_values("top")
    )
    return table["top"].to_numpy(np.int64), table["n"].to_numpy(np.int64)


def frequent_tokens(read: DataFrame, often: tuple[np.ndarray, np.ndarray], most: int = MOST_FREQUENT) -> Frequent:
    """The frequent tokens that tasks have reported, beside those counted over all documents."""
    table = (
        read.filter("token IS NOT NULL").groupBy("token").agg(F.sum("local").alias("n"))
        .orderBy(F.desc("n"), "token").limit(most).toPandas()
    )
    tokens = table["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return Frequent(tokens[order], table["n"].to_numpy(np.int64)[order], *often)


POSTINGS = "key long, node long, side int, own int"


def index_keys(
    documents: DataFrame, text: str, words: int, percent: int, frequent: Frequent
) -> DataFrame:
    """``key, node, side, own`` of every document's index entries; ``own``: the node's rare tokens."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def out(rows: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        keys, sides, nodes, own = zip(*rows, strict=True)
        times = [len(part) for part in keys]
        columns = (
            np.concatenate(keys),
            np.repeat(np.array(nodes, np.int64), times),
            np.concatenate(sides),
            np.repeat(np.array(own, np.int32), times),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow_schema(POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, prefixes = Fingerprints(words), Prefixes(percent, shared.value)
        for batch in slices(batches, 0):
            rows, held = [], 0
            for tokens in prints.of(batch.column(0)):
                if not len(tokens):
                    continue
                keys, sides, own = prefixes.keys(tokens)
                rows.append((keys.view(np.int64), sides, node_id(tokens), own))
                held += len(keys)
                if held > 1 << 18:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, POSTINGS)


def id_bits(ids: DataFrame) -> np.ndarray:
    """Which ids are wanted (column ``at``, hashed), as bits at ``at mod size``: 16 bits per id, at most ``MOST_BITS``.

    The size of what is broadcast is bounded whatever the number of ids; a full map only lets more rows pass, which the
    exact semi join behind it removes.
    """
    count = ids.count()
    size = 1 << 10
    while size < min(MOST_BITS, 16 * count):
        size *= 2
    bit = F.pmod("at", F.lit(size))
    words = (
        ids.select(F.floor(bit / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(at, {size}) % 64 as int))").alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    )
    table = np.zeros(size // 64, np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def sets_of(documents: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``node, tokens`` for the wanted nodes (columns ``node, first_id``), once each.

    Only texts whose id is that of a wanted node's first document are hashed.
    """
    wanted = id_bits(nodes.select(F.xxhash64("first_id").alias("at")))
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, bits = Fingerprints(words), shared.value
        size = np.uint64(len(bits) * 64 - 1)
        for batch in slices(batches, 1):
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & size
            hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            found = [tokens for tokens in prints.of(batch.column(1).filter(pa.array(hit.astype(bool)))) if len(tokens)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_id(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())],
                names=["node", "tokens"],
            )

    rows = documents.select(F.xxhash64(F.col(key).cast("long")).alias("at"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "node long, tokens binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct ``a, b`` those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct ``a, b`` those whose sketches leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "y", "n", "m")]
            mask = pa.array([may_link(*row, percent) for row in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), "n")
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")
    return met.mapInArrow(run, "a long, b long")


def as_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct ordered pairs of (node, n) and (other, m) in different components whose sizes allow a link."""
    fits = (
        (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        & (F.col("comp") != F.col("other_comp"))
        & ((F.col("side") < 0) | (F.col("side") != F.col("other_side")))
    )
    return rows.filter(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def star_pairs(postings: DataFrame) -> DataFrame:
    """Each posting beside the leaders of its key: the members with the fewest tokens of their own, which lie at the
    centre of a group of copies. ``place`` is the posting's own position in that order."""
    order = Window.partitionBy("key").orderBy("own", "node")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct(F.col("node").alias("other"), F.col("n").alias("m"), F.col("side").alias("other_side"))
    leaders = F.array_compact(F.array(*(F.nth_value(member, i + 1).over(whole) for i in range(LEADERS))))
    return (
        postings.withColumn("leaders", leaders)
        .select("node", "n", "side", F.inline("leaders"))
        .withColumn("comp", F.col("node"))
        .withColumn("other_comp", F.col("other"))
    )


def followers(postings: DataFrame) -> DataFrame:
    """The postings that are no leaders of their key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("own", "node"))
    return postings.withColumn("place", place).filter(F.col("place") > LEADERS).drop("place")


def all_pairs(active: DataFrame) -> DataFrame:
    """Pairs of postings of a key that the stars have left in different components."""
    other = active.select(
        "key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("side").alias("other_side"),
        F.col("comp").alias("other_comp"),
    )
    return active.join(other, "key").filter("node < other")


def still_open(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with each node's component, of the keys that hold more than one component."""
    named = postings.join(comps, "node", "left")
    named = named.withColumn("comp", F.coalesce("component", "node")).drop("component")
    return split_keys(named, "comp")


def split_keys(rows: DataFrame, value: str) -> DataFrame:
    """Rows of the keys that still join different ``value``s: least and greatest over a key, without gathering it."""
    by_key = Window.partitionBy("key")
    spread = rows.select("*", *(end.over(by_key).alias(name) for name, end in (
        ("lo", F.min(value)), ("hi", F.max(value)), ("least_side", F.min("side")), ("most_side", F.max("side"))
    )))
    return spread.filter("lo <> hi AND (most_side < 0 OR least_side <> most_side)").select(*rows.columns)


def linked_components(
    documents: DataFrame, nodes: DataFrame, key: str, text: str, words: int, percent: int,
    frequent: Frequent,
) -> DataFrame:
    """``node, component`` of every node that has links; ``nodes`` holds ``node, n, sketch, first_id``."""
    keyed = index_keys(documents, text, words, percent, frequent)
    # The one large exchange: index entries by key. Equal sets share a node, so a key with one node is dropped there.
    postings = split_keys(keyed, "node").distinct()
    postings = spool(postings.join(nodes.select("node", "n"), "node"), "postings")

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = spool(plausible(pairs, nodes, percent), "pairs")
        needed = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        sets = sets_of(documents, nodes.select("node", "first_id").join(needed, "node"), key, text, words)
        return spool(verified(likely, spool(sets, "sets"), percent), "links")

    links = links_of(as_pairs(star_pairs(postings), percent))
    comps = spool(components(links), "components")
    rest = spool(still_open(followers(postings), comps), "open")
    if rest.isEmpty():
        return comps
    more = links_of(as_pairs(all_pairs(rest), percent))
    return comps if more.isEmpty() else spool(components(links.union(more)), "components")


def cluster(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    share: float = FREQUENT_SHARE,
    often: int = OFTEN,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    if not 0 < percent <= 100 or words < 1:
        raise ValueError(f"percent must lie in 1..100 and words be positive, not {percent} and {words}")
    read = spool(read_sets(documents, key, text, words, share), "sets-read")
    frequent = frequent_tokens(read, often_held(documents, text, words, often))
    rows = read.filter("n_shingles IS NOT NULL").select("doc_id", "node", "n_shingles")
    first = F.min_by(F.struct("doc_id", "n_shingles", "sketch"), F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")
    nodes = (
        read.filter("node IS NOT NULL").groupBy("node").agg(first)
        .select("node", F.col("first.n_shingles").alias("n"), "first.sketch", F.col("first.doc_id").alias("first_id"))
    )
    nodes = spool(nodes, "nodes")
    comps = linked_components(documents, nodes, key, text, words, percent, frequent)
    named = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = named.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return named.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(documents: DataFrame, clusters: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of every component; rows without an id stay, repeated rows count once."""
    name, place = unused(documents, "kept_id"), unused(documents, "place")
    kept = clusters.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    with_id = documents.join(kept, documents[key] == kept[name], "left_semi")
    order = F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(key))
    with_id = with_id.withColumn(place, order).filter(F.col(place) == 1).drop(place)
    return with_id.union(documents.filter(F.col(key).isNull()))
