"""Training-order materialisation: token sequences of fixed length, in the order of a keyed permutation.

Documents become token ids with an end mark and are cut into sequences of ``length`` tokens, the last one padded with the
end mark. The sequences are written once; a sequence's index is its file's offset plus its row in that file, so no pass
over the tokens is needed to number them. A keyed Feistel permutation over the next power of four, walked along its cycle
until it falls under the number of sequences, maps the index to a global slot: a bijection that needs no sort and no
table. Range partitions by shard then write the shards: ``rows_per_shard`` slots each, in slot order, every record of
the same stride, so training reads them one after the other and resumes at any slot.

Layout under one folder: ``sequences`` (input order), ``shards/shard=N`` and ``manifest`` (one row).

Defined results
* null and empty texts: no sequence; null ids are carried along; repeated rows are written each;
* token ids are little-endian, two bytes for vocabularies up to 65,536 ids, else four;
* an empty table: no shards, a manifest with 0 sequences; extra columns are not read;
* the assignment of slots is fixed by the key and the written ``sequences`` table; another input split gives another
  numbering, so readers use the shards, which name document and part of every record.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine.llm.arrowtools import arrow_schema, slices
from tontine.sources.shared import fresh_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 512
ROWS_PER_SHARD = 1 << 14
KEY = 0x5EED
ROUNDS = 6
#: Files of the sequence table whose offsets (8 bytes each) reach the tasks.
MOST_FILES = 1 << 22


class Feistel:
    """A keyed bijection of ``range(n)``."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS) -> None:
        self.n, self.key, self.rounds = n, key, rounds
        self.half = max(1, -(-max(0, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)

    def _scramble(self, right: np.ndarray, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = right + np.uint64((self.key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, turns: range) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        if turns.step > 0:
            for turn in turns:
                left, right = right, left ^ self._scramble(right, turn)
        else:
            for turn in turns:
                left, right = right ^ self._scramble(left, turn), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, values: np.ndarray, turns: range) -> np.ndarray:
        out = self._once(np.asarray(values, np.uint64), turns)
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = self._once(out[outside], turns)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, range(self.rounds))

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(self.rounds - 1, -1, -1))


class Tokenizer:
    """Byte-level BPE; ``kind`` is the width of an id."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.kind = np.dtype("<u2") if max(table.values()) < 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.kind).tobytes()


SEQUENCES = "doc_id long, part int, n_tokens int, tokens binary"


def sequences(documents: DataFrame, key: str, text: str, ranks: str, length: int, end: int) -> DataFrame:
    """``doc_id, part, n_tokens, tokens``: fixed-length records of all documents; ``n_tokens`` counts the end mark."""
    with open(ranks, "rb") as file:  # under a megabyte; the workers get it from here
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        stop = np.array([end], tokenizer.kind).tobytes()
        width, stride = len(stop), len(stop) * length
        for batch in slices(batches, 1):
            rows, parts, counts, records = [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                if not body:
                    continue
                data = tokenizer.encode(body) + stop
                for part, start in enumerate(range(0, len(data), stride)):
                    piece = data[start : start + stride]
                    rows.append(row)
                    parts.append(part)
                    counts.append(len(piece) // width)
                    records.append(piece + stop * ((stride - len(piece)) // width))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(parts, pa.int32()), pa.array(counts, pa.int32()), pa.array(records, pa.binary())],
                schema=arrow_schema(SEQUENCES),
            )

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SEQUENCES)


def materialise(
    documents: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    ranks: str = RANKS,
    length: int = LENGTH,
    end: int = END,
    rows_per_shard: int = ROWS_PER_SHARD,
    order_key: int = KEY,
) -> None:
    """Write ``sequences``, ``shards`` and ``manifest`` under ``path``."""
    if length < 1 or rows_per_shard < 1:
        raise ValueError(f"length and rows_per_shard must be positive, not {length} and {rows_per_shard}")
    spark = documents.sparkSession
    sequences(documents, key, text, ranks, length, end).write.option("compression", "zstd").parquet(f"{path}/sequences")
    written = spark.read.schema(SEQUENCES.replace(", ", ",")).parquet(f"{path}/sequences")
    # A task may write several files; the whole name tells them apart.
    numbered = written.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = {r["file"]: r["n"] for r in numbered.groupBy("file").agg(F.count("*").alias("n")).limit(MOST_FILES + 1).collect()}
    if len(counts) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} sequence files; write them from fewer tasks")
    total, places = 0, []
    for name in sorted(counts):
        places.append((name, total))
        total += counts[name]
    # At most MOST_FILES rows.
    placed = F.broadcast(spark.createDataFrame(places, "file string, first long"))

    @F.pandas_udf("long")
    def slot(place: pd.Series) -> pd.Series:
        return pd.Series(Feistel(total, order_key).slot(place.to_numpy(np.int64)))

    shards = -(-total // rows_per_shard)
    if total:
        (
            numbered.join(placed, "file")
            .select(slot(F.col("first") + F.col("row")).alias("slot"), "doc_id", "part", "n_tokens", "tokens")
            .withColumn("shard", F.floor(F.col("slot") / rows_per_shard).cast("int"))
            .repartitionByRange(shards, "shard")
            .sortWithinPartitions("shard", "slot")
            .write.option("compression", "zstd")
            .partitionBy("shard")
            .parquet(f"{path}/shards")
        )
    manifest = [(total, length, rows_per_shard, shards, order_key, end)]
    spark.createDataFrame(
        manifest, "sequences long, length int, rows_per_shard int, shards int, order_key long, end_token int"
    ).coalesce(1).write.parquet(f"{path}/manifest")


RECORDS = "slot long, doc_id long, part int, n_tokens int, tokens binary, shard int"


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Records from a slot on; shards before it are not opened."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if not manifest["sequences"]:
        return spark.createDataFrame([], RECORDS)
    records = spark.read.schema(RECORDS).parquet(f"{path}/shards")
    first = from_slot // manifest["rows_per_shard"]
    return records.filter((F.col("shard") >= first) & (F.col("slot") >= from_slot))


def archive(documents: DataFrame, **options) -> str:
    """Materialise into the shared folder and return the path."""
    path = fresh_path(documents.sparkSession, "training-order")
    materialise(documents, path, **options)
    return path
