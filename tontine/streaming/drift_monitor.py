"""Live drift monitoring: mergeable counts per arriving part, metrics and retraining events on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tontine import schemas as S
from tontine.operators import drift, lifecycle, quality
from tontine.sources.shared import spool


class DriftMonitor:
    """Counts micro-batches against a frozen reference; metrics follow from the summed counts.

    Each micro-batch stores what adds up (bins, categories, rows, sums, flags) in partitions of batch number and epoch.
    A batch may therefore arrive in any number of files, over several micro-batches and in any order, and a replayed
    micro-batch rewrites its own partitions instead of doubling them.
    """

    def __init__(self, reference: drift.DriftReference, scorer, path: str):
        self.reference = reference
        self.scorer = scorer
        self.path = path

    @classmethod
    def of(cls, stored: DataFrame, scorer, path: str) -> "DriftMonitor":
        """A monitor whose reference is the window of a stored stream; a stream that cannot be monitored is refused."""
        quality.expect_monitorable(stored)
        return cls(drift.fit_reference(scorer(stored)), scorer, path)

    def process(self, micro_batch: DataFrame, epoch: int) -> None:
        scored = self.scorer(micro_batch).persist()
        try:
            self._store(drift.batch_counts(scored, self.reference.edges), epoch, "counts")
            self._store(drift.categorical_histogram(scored), epoch, "categories")
        finally:
            scored.unpersist()

    def _store(self, counts: DataFrame, epoch: int, name: str) -> None:
        (
            counts.withColumn("epoch", F.lit(epoch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "epoch")
            .parquet(f"{self.path}/{name}")
        )

    def metrics(self, spark: SparkSession) -> DataFrame:
        """One row per batch seen so far, over all of its parts."""
        batch = F.col("batch_id").cast("int").alias("batch_id")
        counts = spark.read.parquet(f"{self.path}/counts")
        counts = counts.select(batch, *(F.col(f"`{c}`") for c in counts.columns if c != "batch_id"))
        categories = spark.read.parquet(f"{self.path}/categories").groupBy(batch, "feature", "bin").agg(F.sum("n").alias("n"))
        profile = spool(drift.profile_of(drift.merge_counts(counts)), "monitor-profile")
        return drift.score_profiles(profile, spool(categories, "monitor-categories"), self.reference)

    def events(self, spark: SparkSession) -> DataFrame:
        """Retraining events of all batches seen so far."""
        return trigger_retraining(spool(self.metrics(spark), "monitor-metrics"))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def stream_batches(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", False)
        .parquet(path)
    )


def trigger_retraining(metrics: DataFrame) -> DataFrame:
    """Events of all batches measured so far."""
    return lifecycle.retraining_events(metrics, S.WINDOW_BATCHES)
