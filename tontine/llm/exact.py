"""Exact duplicates through an extendible-hash index on shared files.

A text's key is the head of the SHA-256 of its normalised bytes (A-Z in lower case, nothing else changed). A bucket is the
range of keys with one prefix; the directory holds a row per bucket and is grown by splitting overfull buckets by their next
bit, doubling whenever a bucket is as deep as the directory. Buckets lie under ``buckets/version=N`` as files sorted by key;
``directory/version=N`` is written last and makes version N valid. An insertion writes the buckets it touches anew, every
other bucket stays where its directory row says, so a failed insertion leaves the index as it was.

Copies are folded inside the tasks that read them, so a text that fills a third of all rows reaches its owner once per task.
An owner task gets a run of consecutive buckets, streams it by key and keeps one chain of texts at a time: texts of one key
are told apart by comparing their bytes. Documents find their link of a chain by (key, digest); two different texts with one
digest would end the job, never merge. What is joined back is narrow, and the groups that hold more than 1 / 4,096 of the
rows, 4,096 at most, are broadcast.

Defined results
* null text: empty; all empty texts are one group;
* null id: counts in its group; never stays where the group holds another id, stays (every such row) where it holds none;
* repeated rows: each counts; all rows of the id that stays are kept, as they are one document;
* the text decides alone: other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine.llm.arrowtools import LOWER_ASCII, arrow_schema, encoded, slices
from tontine.sources.shared import fresh_path, spool

KEY_BITS = 60
#: Bytes of distinct text at which a bucket splits, at least, and the most buckets: a larger index has larger buckets.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 19
#: An owner task takes consecutive buckets up to so many capacities.
OWNER_CAPACITIES = 3
#: Distinct text a task holds while it folds copies; what an owner hands on at a time.
FOLD_BYTES, OUT_BYTES = 24 << 20, 4 << 20
#: The first histogram counts by so many bits, later ones by a few more inside overfull prefixes.
FIRST_BITS, MORE_BITS = 16, 4
#: Groups of more than one in so many rows are joined by broadcast.
HEAVY = 4096

ENTRY = "doc_id long, key long, digest binary, n_bytes long"
FOLDED = "owner int, key long, digest binary, body binary, keep_id long, group_size long"
LINK = "bucket long, depth int, key long, chain int, digest binary, n_bytes long, keep_id long, group_size long, body binary"
DIRECTORY = "bucket long, depth int, home int, owner int, n_bytes long, n_texts long, key_bits int"


class IndexDamage(RuntimeError):
    """Stored or computed digests do not tell texts apart."""


@dataclass(frozen=True)
class Bucket:
    """Keys whose first ``depth`` bits are ``prefix``; ``home`` is the version that wrote its file."""

    prefix: int
    depth: int
    n_bytes: int = 0
    n_texts: int = 0
    home: int = -1
    owner: int = 0


@dataclass(frozen=True)
class Directory:
    version: int
    key_bits: int
    buckets: tuple[Bucket, ...] = field(default_factory=tuple)

    @property
    def depth(self) -> int:
        return max(b.depth for b in self.buckets)

    def first_key(self, bucket: Bucket) -> int:
        return bucket.prefix << (self.key_bits - bucket.depth)


def key_of(digest: bytes, key_bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - key_bits)


def documents_entries(docs: DataFrame, key: str, text: str, key_bits: int) -> DataFrame:
    """``doc_id, key, digest, n_bytes`` of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bodies = [(x or b"").translate(LOWER_ASCII) for x in encoded(batch.column(1))]
            digests = [hashlib.sha256(x).digest() for x in bodies]
            columns = [
                batch.column(0),
                pa.array([key_of(d, key_bits) for d in digests], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([len(x) for x in bodies], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(ENTRY))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(name, ENTRY)


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def folded_copies(docs: DataFrame, key: str, text: str, directory: Directory, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """Distinct texts of each task, with their owner: equal bytes are folded to the largest id and a count."""
    route = router(docs.sparkSession, directory)
    key_bits = directory.key_bits

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in slices(batches, 1):
            for doc_id, body in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                body = (body or b"").translate(LOWER_ASCII)
                known = held.get(body)
                if known is None:
                    held[body] = [doc_id, 1]
                    size += len(body) + 200
                else:
                    known[0], known[1] = larger(known[0], doc_id), known[1] + 1
            if size >= fold_bytes:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for part in parts(rows, lambda row: len(row[0])):
            digests = [hashlib.sha256(body).digest() for body, _ in part]
            keys = np.array([key_of(d, key_bits) for d in digests], np.int64)
            columns = [
                pa.array(route(keys), pa.int32()),
                pa.array(keys),
                pa.array(digests, pa.binary()),
                pa.array([body for body, _ in part], pa.binary()),
                pa.array([found[0] for _, found in part], pa.int64()),
                pa.array([found[1] for _, found in part], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(FOLDED))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(fold, FOLDED)


def parts(rows: list, size_of) -> Iterator[list]:
    """Runs of rows of about ``OUT_BYTES`` bytes, one row at least."""
    start, total = 0, 0
    for at, row in enumerate(rows):
        total += size_of(row)
        if total >= OUT_BYTES:
            yield rows[start : at + 1]
            start, total = at + 1, 0
    if start < len(rows):
        yield rows[start:]


def router(spark: SparkSession, directory: Directory):
    """A function from keys to owners; the directory's size is bounded by ``MOST_BUCKETS``."""
    starts = np.array([directory.first_key(b) for b in directory.buckets], np.int64)
    owners = np.array([b.owner for b in directory.buckets], np.int32)
    shared = spark.sparkContext.broadcast((starts, owners))
    return lambda keys: shared.value[1][np.searchsorted(shared.value[0], keys, side="right") - 1]


def distinct_texts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key", "digest").agg(F.max("n_bytes").alias("n_bytes"))


def split_overfull(directory: Directory, texts: DataFrame, least: int = BUCKET_BYTES) -> tuple[Directory, int]:
    """Split what exceeds the capacity, doubling the directory as needed; ``texts``: all distinct ``key, digest, n_bytes``.

    Counts by prefix come to the driver: 2^16 rows at first, then 16 for each prefix that is still overfull, of which there
    are fewer than ``MOST_BUCKETS`` (all bytes over the capacity). A bucket of one text never splits, however long it is.
    """
    key_bits = directory.key_bits
    level, wanted, capacity = min(FIRST_BITS, key_bits), None, least
    buckets, done = list(directory.buckets), []
    while True:
        prefix = F.shiftright("key", key_bits - level)
        counted = texts.select(prefix.alias("prefix"), "n_bytes").groupBy("prefix").agg(F.sum("n_bytes"), F.count("*"))
        if wanted is not None:
            counted = counted.join(F.broadcast(wanted), F.shiftright("prefix", level - before) == F.col("wanted")).drop("wanted")
        rows = np.array(sorted(tuple(r) for r in counted.collect()), np.int64).reshape(-1, 3)
        sums = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(rows[:, 1:], axis=0)))
        if wanted is None:
            capacity = max(least, -(-2 * int(sums[-1, 0]) // MOST_BUCKETS))

        def filled(b: Bucket) -> Bucket:
            first = b.prefix << (level - b.depth)
            at = np.searchsorted(rows[:, 0], [first, first + (1 << (level - b.depth))])
            n_bytes, n_texts = (int(x) for x in sums[at[1]] - sums[at[0]])
            return replace(b, n_bytes=n_bytes, n_texts=n_texts)

        buckets, deeper = [filled(b) for b in buckets if b.depth <= level], [b for b in buckets if b.depth > level]
        while buckets:  # a pass splits every overfull bucket by its next bit
            over = [b for b in buckets if b.n_bytes > capacity and b.n_texts > 1 and b.depth < level]
            kept = {id(b) for b in over}
            done += [b for b in buckets if id(b) not in kept]
            buckets = [
                filled(Bucket((b.prefix << 1) | bit, b.depth + 1)) for b in over for bit in (0, 1)
            ]  # buckets as deep as the directory double it
        open_ = [b for b in done if b.depth == level and b.n_bytes > capacity and b.n_texts > 1]
        if level == key_bits or not (open_ or deeper):
            done += deeper
            break
        marked = {id(b) for b in open_}
        done = [b for b in done if id(b) not in marked]
        before, level = level, min(key_bits, level + MORE_BITS)
        buckets = open_ + deeper
        heads = [(b.prefix if b.depth <= before else b.prefix >> (b.depth - before),) for b in buckets]
        wanted = texts.sparkSession.createDataFrame(sorted(set(heads)), "wanted long")
    ordered = sorted(done, key=lambda b: b.prefix << (key_bits - b.depth))
    return replace(directory, buckets=tuple(ordered)), capacity


def with_owners(directory: Directory, capacity: int) -> Directory:
    """Consecutive buckets share an owner up to ``OWNER_CAPACITIES`` capacities."""
    owner, held, out = 0, 0, []
    for b in directory.buckets:
        if held and held + b.n_bytes > OWNER_CAPACITIES * capacity:
            owner, held = owner + 1, 0
        held += b.n_bytes
        out.append(replace(b, owner=owner))
    return replace(directory, buckets=tuple(out))


def write_directory(spark: SparkSession, path: str, directory: Directory) -> None:
    rows = [(directory.first_key(b), b.depth, b.home, b.owner, b.n_bytes, b.n_texts, directory.key_bits) for b in directory.buckets]
    spark.createDataFrame(rows, DIRECTORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory/version={directory.version}")


def create(spark: SparkSession, path: str, key_bits: int = KEY_BITS) -> None:
    """An index of one empty bucket."""
    write_directory(spark, path, Directory(0, key_bits, (Bucket(0, 0),)))


def directory_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    rows = spark.read.schema(f"{DIRECTORY}, version int").parquet(f"{path}/directory")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == version)


def read_directory(spark: SparkSession, path: str) -> Directory:
    rows = sorted(directory_rows(spark, path).collect())
    key_bits = rows[0].key_bits
    buckets = (Bucket(r.bucket >> (key_bits - r.depth), r.depth, r.n_bytes, r.n_texts, r.home, r.owner) for r in rows)
    return Directory(rows[0].version, key_bits, tuple(buckets))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Every link of every chain: the columns of ``LINK``. Files of buckets that were written anew since are passed over."""
    homes = directory_rows(spark, path, version).select("bucket", "depth", F.col("home").alias("version"))
    files = spark.read.schema(f"{LINK}, version int").option("mergeSchema", "false")
    if homes.filter("version >= 0").isEmpty():
        return spark.createDataFrame([], LINK)
    links = files.parquet(f"{path}/buckets")
    return links.join(F.broadcast(homes), ["bucket", "depth", "version"], "left_semi").drop("version")


def owned_chains(spark: SparkSession, folded: DataFrame, directory: Directory) -> DataFrame:
    """Owner tasks: each reads its key range in order and chains what differs in bytes."""
    starts = [directory.first_key(b) for b in directory.buckets]
    shared = spark.sparkContext.broadcast((np.array(starts, np.int64), np.array([b.depth for b in directory.buckets], np.int32)))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[list] = []
        current, out, size = None, [], 0
        for batch in slices(batches, 3):
            columns = (batch.column(i).to_pylist() for i in range(1, 6))
            for key, digest, body, keep_id, n in zip(*columns, strict=True):
                if key != current:
                    out += finished(links)
                    links, current = [], key
                for link in links:
                    if link[2] == body:
                        link[3], link[4] = larger(link[3], keep_id), link[4] + n
                        break
                else:
                    links.append([key, digest, body, keep_id, n])
                    size += len(body) + 100
            if size >= OUT_BYTES:
                for part in parts(out, lambda row: len(row[3])):
                    yield packed(part)
                out, size = [], 0
        out += finished(links)
        for part in parts(out, lambda row: len(row[3])):
            yield packed(part)

    def finished(links: list[list]) -> list[tuple]:
        links.sort(key=lambda link: (link[1], link[2]))
        for one, other in zip(links[:-1], links[1:], strict=True):
            if one[1] == other[1]:
                raise IndexDamage(f"two texts share the digest {one[1].hex()}")
        return [(link[0], at, *link[1:]) for at, link in enumerate(links)]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        first, depth = shared.value
        keys, chain_at, digests, bodies, keeps, sizes = zip(*rows, strict=True)
        at = np.searchsorted(first, np.array(keys, np.int64), side="right") - 1
        columns = [
            pa.array(first[at]), pa.array(depth[at]), pa.array(keys, pa.int64()), pa.array(chain_at, pa.int32()),
            pa.array(digests, pa.binary()), pa.array([len(x) for x in bodies], pa.int64()), pa.array(keeps, pa.int64()),
            pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema(LINK))

    owners = directory.buckets[-1].owner + 1
    ranged = folded.repartitionById(owners, "owner").sortWithinPartitions("key")
    return ranged.mapInArrow(chain, LINK)


def rerouted(links: DataFrame, directory: Directory) -> DataFrame:
    """Stored links as folded rows of the owners that take them now."""
    route = router(links.sparkSession, directory)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = route(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), *batch.columns], schema=arrow_schema(FOLDED))

    return links.select("key", "digest", "body", "keep_id", "group_size").mapInArrow(owned, FOLDED)


def insert(
    spark: SparkSession,
    path: str,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    entries: DataFrame | None = None,
) -> Directory:
    """Add all rows of ``docs``; the buckets they touch, and those that split, are written under the next version."""
    old = read_directory(spark, path)
    if entries is None:
        entries = spool(documents_entries(docs, key, text, old.key_bits), "entries")
    stored = read_index(spark, path)
    fresh = distinct_texts(entries)
    everything = distinct_texts(entries.select("key", "digest", "n_bytes").union(stored.select("key", "digest", "n_bytes")))
    grown, capacity = split_overfull(old, spool(everything, "texts") if old.version else everything, bucket_bytes)
    version = old.version + 1
    before = {(b.prefix, b.depth): b for b in old.buckets}
    touched = {old.first_key(b) for b in old.buckets} if not old.version else touched_buckets(fresh, old)
    buckets = []
    for b in grown.buckets:
        same = before.get((b.prefix, b.depth))
        moved = same is None or same.home < 0 or old.first_key(same) in touched
        buckets.append(replace(b, home=version if moved else same.home))
    grown = with_owners(replace(grown, version=version, buckets=tuple(buckets)), capacity)
    folded = folded_copies(docs, key, text, grown)
    if old.version:
        left = {(b.prefix, b.depth) for b in grown.buckets}
        again = [
            (old.first_key(b), b.depth) for b in old.buckets if old.first_key(b) in touched or (b.prefix, b.depth) not in left
        ]
        wanted = spark.createDataFrame(again, "bucket long, depth int")
        folded = folded.union(rerouted(stored.join(F.broadcast(wanted), ["bucket", "depth"], "left_semi"), grown))
    chains = owned_chains(spark, folded, grown)
    chains.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/buckets/version={version}")
    write_directory(spark, path, grown)
    return grown


def touched_buckets(texts: DataFrame, directory: Directory) -> set[int]:
    """First keys of the buckets that ``texts`` fall into, at most as many as the directory holds."""
    starts = np.array([directory.first_key(b) for b in directory.buckets], np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(starts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column(0).to_numpy(), side="right") - 1
            seen = np.union1d(seen, shared.value[at])
        yield pa.RecordBatch.from_arrays([pa.array(seen)], schema=arrow_schema("bucket long"))

    return {r.bucket for r in texts.select("key").mapInArrow(find, "bucket long").distinct().collect()}


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, chain``."""
    spark = docs.sparkSession
    path = fresh_path(spark, "exact-index")
    create(spark, path, key_bits)
    entries = spool(documents_entries(docs, key, text, key_bits), "entries")
    insert(spark, path, docs, key, text, bucket_bytes, entries)
    return resolve(entries, read_index(spark, path))


def resolve(entries: DataFrame, links: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Documents beside the link of the chain that holds their text."""
    total = entries.count()
    groups = links.select("key", "digest", "chain", "keep_id", "group_size")
    large = F.col("group_size") * heavy > total
    few = F.broadcast(groups.filter(large).select("key", "digest"))  # group sizes sum to the rows: at most ``heavy`` groups
    rows = entries.select("doc_id", "key", "digest")
    hot = rows.join(F.broadcast(groups.filter(large)), ["key", "digest"])
    rest = rows.join(few, ["key", "digest"], "left_anti").join(groups.filter(~large), ["key", "digest"])
    return hot.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "chain",
    )
