"""Live request metrics over event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tontine.operators import observability
from tontine.sources.shared import fresh_path


def windowed_requests(requests: DataFrame, edges: Sequence[float], width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling windows per path; a window closes when the watermark passes its end.

    State is one row per open window and path. Rows later than ``lateness`` are dropped,
    which is what the watermark is for; ``LiveWindows`` keeps them.
    """
    return observability.windowed_requests(requests.withWatermark("ts", lateness), edges, width)


def start(metrics: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append closed windows to a table; the file sink commits each micro-batch once."""
    writer = metrics.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class LiveWindows:
    """Windows that can be read at any time and take rows of any age.

    A micro-batch stores its own sums per window and path (counts, errors, latency sum, cumulative buckets: all of it adds
    up) in a partition of its own, so a replay overwrites what it wrote before. ``windows`` adds the partitions up.
    ``compact`` replaces the partitions of finished micro-batches by their sum; it is a new table whose path takes effect
    when the monitor is opened on it, so a reader of the old one is not disturbed.
    """

    def __init__(self, edges: Sequence[float], path: str, width: str = "5 minutes"):
        self.edges, self.path, self.width = tuple(edges), path, width

    @property
    def sums(self) -> list[str]:
        return ["request_count", "error_count", "latency_sum", *(f"le_{i}" for i in range(len(self.edges)))]

    def process(self, requests: DataFrame, epoch: int) -> None:
        part = observability.windowed_requests(requests, self.edges, self.width)
        self._store(part.withColumn("epoch", F.lit(epoch).cast("long")), self.path)

    def _store(self, part: DataFrame, path: str) -> None:
        writer = part.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("epoch").parquet(f"{path}/windows")

    def _added_up(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start", "path").agg(*(F.sum(c).alias(c) for c in self.sums))

    def windows(self, spark: SparkSession) -> DataFrame:
        """All windows seen so far, one row per window and path."""
        return self._added_up(spark.read.parquet(f"{self.path}/windows"))

    def compact(self, spark: SparkSession, up_to_epoch: int) -> "LiveWindows":
        """The same windows with the partitions up to a finished micro-batch in one."""
        parts = spark.read.parquet(f"{self.path}/windows")
        old = F.col("epoch") <= up_to_epoch
        path = fresh_path(spark, "windows")
        self._store(self._added_up(parts.filter(old)).withColumn("epoch", F.lit(up_to_epoch).cast("long")), path)
        rest = parts.filter(~old).withColumn("epoch", F.col("epoch").cast("long"))
        rest.write.mode("append").partitionBy("epoch").parquet(f"{path}/windows")
        return LiveWindows(self.edges, path, self.width)

    def start(self, requests: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
