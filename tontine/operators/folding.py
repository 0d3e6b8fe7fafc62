"""Sums of arrays over a table: folded inside tasks, added up in rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that one task, or the driver, adds up.
FAN = 64
_PART = pa.schema([("part", pa.binary())])


def array_sum(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum of ``fold`` (an array of ``length`` doubles) over all tasks of ``df``; at most ``FAN`` parts reach the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fold(batches).tobytes()], pa.binary())], schema=_PART)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=_PART)

    parts, tasks = df.mapInArrow(first, "part binary"), df.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(add, "part binary")
    total = np.zeros(length)
    for row in parts.collect():
        total += np.frombuffer(row[0])
    return total
