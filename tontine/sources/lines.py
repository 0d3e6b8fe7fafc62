"""Line numbers of text files that are read in splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PLACED = "path string, split long, place long, value binary"
_SCHEMA = pa.schema([("path", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("value", pa.binary())])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each line within its split; a task reads one split after the other, each in order."""
    last, upto = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column(0).dictionary_encode()
        codes, splits = paths.indices.to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1
        place = np.empty(batch.num_rows, np.int64)
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = (paths.dictionary[codes[start]].as_py(), int(splits[start]))
            upto = upto if key == last else 0
            place[start:stop] = np.arange(upto, upto + stop - start)
            last, upto = key, upto + stop - start
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), batch.column(2)], schema=_SCHEMA)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value``: every line with its number in its file, from 1.

    Splits count their lines, and a running sum per file over these counts (one row a split) tells where each begins; no
    file passes through one task.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )
    counts = read.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = read.mapInArrow(_placed, PLACED)
    return placed.join(starts, ["path", "split"]).select(
        "path", (F.col("before") + F.col("place") + 1).alias("line"), F.col("value").cast("string").alias("value")
    )
