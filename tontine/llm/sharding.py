"""Sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots. Only the bytes per slot decide which shard a slot belongs to, so the
slot-to-shard map is small whatever the corpus: it is a table of ``slots`` rows with a version, and rebalancing edits
the map instead of rehashing records.

Law: ``bytes``. The first map places slots by falling size on the lightest shard; later versions move single slots.

Defined results
* null text: counts 8 bytes, CRC of no bytes (0); null id: hashed by its text like any other row;
* empty table: an empty result and a map that deals out empty slots evenly;
* repeated rows (same id and text): spread over the slots one by one, each row gets its own position;
* extra columns: not read, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tontine.sources.shared import fresh_path, spool

#: Thousands of slots keep the largest slot far below a shard; the map stays a few thousand rows.
SLOTS = 6144
#: The map and the byte counts per slot pass through the driver; this bounds them.
MAX_SLOTS = 1 << 18
RECORD_OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[slot]`` for every slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]


def virtual_slot(key: Column, text: Column, slots: int) -> Column:
    """The slot of a record: by key and text, so that neither a hot key nor a group of copies fills one slot.

    ``spread_repeats`` deals out the rows that agree in both.
    """
    return F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int")


def keyed_records(documents: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``key, size, text_crc32, vslot`` of every record; the text itself is not carried on."""
    if not 0 < slots <= MAX_SLOTS:
        raise ValueError(f"slots must lie in 1..{MAX_SLOTS}, not {slots}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(key), F.col(text), slots).alias("vslot"),
    )


def spread_repeats(records: DataFrame, slots: int) -> DataFrame:
    """Records with the repeats of a row (equal key, size and CRC) dealt over the slots.

    Counts of equal rows are folded map-side; only where some repeat are they marked and given a slot by their place in the
    table. That place is not the same in every run, so the result is written once and read by all that follows.
    """
    same = ("key", "text_crc32", "size")
    repeated = records.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = spool(repeated.select(*(F.col(c).alias(f"{c}_again") for c in same), F.lit(True).alias("again")), "repeats")
    if repeated.isEmpty():
        return records
    alike = [F.col(c).eqNullSafe(F.col(f"{c}_again")) for c in same]
    salted = F.pmod(F.xxhash64("vslot", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    spread = F.when(F.col("again"), salted).otherwise(F.col("vslot")).alias("vslot")
    return spool(records.join(repeated, alike, "left").select(*same, spread), "records")


def slot_loads(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot; at most ``slots`` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for row in records.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[row["vslot"]], count[row["vslot"]] = row["size"], row["n"]
    return size, count


def first_map(size: list[int], shards: int) -> SlotMap:
    """Slots by falling bytes, each to the shard with the fewest bytes so far (ties: fewer slots, smaller shard)."""
    if shards < 1:
        raise ValueError(f"a map needs at least one shard, not {shards}")
    heap = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + size[slot], held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def grow(current: SlotMap, size: list[int]) -> SlotMap:
    """The next version with one more shard: slots move only into the new shard, until it holds its share."""
    shards, shard_of = current.shards + 1, list(current.shard_of)
    share, taken = sum(size) / shards, 0
    load = [0] * current.shards
    for slot, shard in enumerate(shard_of):
        load[shard] += size[slot]
    for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
        shard = shard_of[slot]
        if size[slot] and taken + size[slot] <= share and load[shard] - size[slot] >= share - size[slot] / 2:
            shard_of[slot], load[shard], taken = shards - 1, load[shard] - size[slot], taken + size[slot]
    return SlotMap(current.version + 1, shards, tuple(shard_of))


def rebalance(current: SlotMap, size: list[int], tolerance: float = 0.02) -> SlotMap:
    """The next version after sizes have changed: moves single slots from the heaviest to the lightest shard, no more
    than needed to bring every shard within ``tolerance`` of the mean or until no move helps."""
    shard_of, held = list(current.shard_of), [[] for _ in range(current.shards)]
    load = [0] * current.shards
    for slot, shard in enumerate(shard_of):
        load[shard] += size[slot]
        held[shard].append(slot)
    mean = sum(size) / current.shards
    for _ in range(len(size)):
        heavy = max(range(current.shards), key=lambda s: (load[s], -s))
        light = min(range(current.shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        movable = [s for s in held[heavy] if 0 < size[s] < gap]
        if load[heavy] <= mean * (1 + tolerance) and load[light] >= mean * (1 - tolerance) or not movable:
            break
        slot = min(movable, key=lambda s: (abs(gap / 2 - size[s]), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        shard_of[slot], load[heavy], load[light] = light, load[heavy] - size[slot], load[light] + size[slot]
    return SlotMap(current.version + 1, current.shards, tuple(shard_of))


def store_map(spark: SparkSession, versions: list[SlotMap], path: str) -> None:
    """Versions of a map as one table partitioned by version; earlier versions stay readable."""
    rows = [(m.version, m.shards, slot, shard) for m in versions for slot, shard in enumerate(m.shard_of)]
    spark.createDataFrame(rows, "version int, shards int, slot int, shard int").write.mode("append").partitionBy(
        "version"
    ).parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest without ``version``."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).collect()
    shard_of = {row["slot"]: row["shard"] for row in rows}
    return SlotMap(version, rows[0]["shards"], tuple(shard_of[s] for s in range(len(shard_of))))


def assign(records: DataFrame, slot_map: SlotMap, count: list[int]) -> DataFrame:
    """Shard of every record and its position there, gapless from 0.

    A shard's records lie slot after slot. The map with each slot's first position has one row per slot, so it is
    broadcast; a record's rank inside its slot needs one shuffle of (key, size, crc) by slot.
    """
    first, filled = [], [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        first.append((slot, shard, filled[shard]))
        filled[shard] += count[slot]
    spark = records.sparkSession
    placed = F.broadcast(spark.createDataFrame(first, "vslot int, shard int, first long"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("key", "text_crc32", "size"))
    return (
        records.withColumn("rank", rank)
        .join(placed, "vslot")
        .select("key", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "vslot")
    )


def shard(documents: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS):
    """Deal ``documents`` into ``shards`` of near equal bytes. Returns (assignment, map, path of the stored map)."""
    records = spread_repeats(keyed_records(documents, key, text, slots), slots)
    size, count = slot_loads(records, slots)
    slot_map = first_map(size, shards)
    path = fresh_path(documents.sparkSession, "slot-map")
    store_map(documents.sparkSession, [slot_map], path)
    return assign(records, load_map(documents.sparkSession, path), count), slot_map, path
