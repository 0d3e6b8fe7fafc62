"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def encoded(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without building Python strings."""
    return column.cast(pa.binary()).to_pylist()


#: A-Z to a-z, every other byte unchanged.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer for uint64 arrays (two xor-shift-multiply steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value occurs in the sorted array ``of``, by way of a small table that settles most of them."""
    if not len(of):
        return np.zeros(len(values), bool)
    bits = 20
    table = np.zeros(1 << bits, bool)
    table[(of >> np.uint64(64 - bits)).astype(np.int64)] = True
    out = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(of, values[maybe])
    at[at == len(of)] = 0
    out[maybe] = of[at] == values[maybe]
    return out


def slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, stop - start)


@functools.lru_cache(maxsize=8)
def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a comma-separated ``name type`` list with the few types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])
