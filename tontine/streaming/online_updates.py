"""The online candidate inside the micro-batch loop: versioned state, one row per step.

A micro-batch reads the state that stood before it, moves it over its rows in order of batch number and writes the result
under its own epoch. A replayed micro-batch starts from the same state and overwrites its own rows, so nothing is learned
twice. The gradient of a batch adds up over its parts: while parts of the open batch arrive, all of them are measured at
the weights from before the batch, and the weights after it are those of one step on the whole batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tontine import schemas as S
from tontine.operators import encoding, online, scoring
from tontine.sources.tables import read_optional

STATE = (
    "batch_id int, step int, n_rows long, loss_sum double, bias_sum double, gradient_sum array<double>, "
    "base_weights array<double>, base_intercept double, weights array<double>, intercept double, late boolean"
)


class OnlineUpdates:
    """``encoder`` is frozen: a stream never refits it. ``first`` is the candidate fitted on the reference window."""

    def __init__(self, encoder: PipelineModel, first: online.OnlineModel, path: str):
        self.encoder, self.first, self.path = encoder, first, path

    def rows(self, spark: SparkSession) -> DataFrame:
        """Every stored row, ``epoch`` and ``position`` (its place in the epoch) included."""
        return read_optional(spark, self.path, spark.createDataFrame([], f"position int, {STATE}, epoch long").schema, "parquet")

    def before(self, spark: SparkSession, epoch: int) -> Row | None:
        """The state that an epoch starts from."""
        stored = self.rows(spark).filter(F.col("epoch") < epoch)
        return stored.orderBy(F.desc("epoch"), F.desc("position")).first()

    def process(self, micro_batch: DataFrame, epoch: int) -> None:
        spark = micro_batch.sparkSession
        encoded = encoding.encode(scoring.model_inputs(micro_batch), self.encoder)
        encoded = encoded.select("batch_id", S.TARGET, encoding.FEATURES).persist()
        try:
            state, out = self.before(spark, epoch), []
            for (batch_id,) in sorted(tuple(r) for r in encoded.select("batch_id").distinct().collect()):
                state = self._step(encoded.filter(F.col("batch_id") == batch_id), batch_id, state)
                out.append(state)
        finally:
            encoded.unpersist()
        names = [part.split()[0] for part in STATE.split(", ")]
        rows = [(at, *(r[name] for name in names), epoch) for at, r in enumerate(out)]
        table = spark.createDataFrame(rows, f"position int, {STATE}, epoch long").coalesce(1)
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(self.path)

    def _step(self, part: DataFrame, batch_id: int, state: Row | None) -> Row:
        """The state after one more part; a part of a batch that is over takes a step of its own, marked ``late``."""
        if state is not None and state["batch_id"] == batch_id and not state["late"]:
            base = online.OnlineModel(np.array(state["base_weights"]), state["base_intercept"], state["step"] - 1)
            before = (state["n_rows"], state["loss_sum"], state["bias_sum"], np.array(state["gradient_sum"]))
            late = False
        else:
            last = self.first if state is None else online.OnlineModel(np.array(state["weights"]), state["intercept"], state["step"])
            base, before, late = last, (0, 0.0, 0.0, np.zeros_like(last.weights)), state is not None and batch_id < state["batch_id"]
        gradient, bias, loss, n = online.gradient(part, base)
        total = before[0] + n
        loss_sum, bias_sum, gradient_sum = before[1] + loss * n, before[2] + bias * n, before[3] + gradient * n
        after = online.stepped(base, gradient_sum / max(total, 1), bias_sum / max(total, 1))
        return Row(
            # A late part leaves the newest batch number in place, so the batches after it are not late themselves.
            batch_id=state["batch_id"] if late else batch_id, step=after.steps, n_rows=total, loss_sum=float(loss_sum),
            bias_sum=float(bias_sum), gradient_sum=[float(x) for x in gradient_sum], base_weights=[float(x) for x in base.weights],
            base_intercept=float(base.intercept), weights=[float(x) for x in after.weights], intercept=float(after.intercept), late=late,
        )

    def steps(self, spark: SparkSession) -> DataFrame:
        """``step, batch_id, n_rows, log_loss`` of every step, the loss being that from before it."""
        newest = F.max_by(F.struct("n_rows", "loss_sum", "batch_id", "late"), F.struct("epoch", "position"))
        return (
            self.rows(spark)
            .groupBy("step")
            .agg(newest.alias("s"))
            .select("step", "s.batch_id", "s.n_rows", (F.col("s.loss_sum") / F.col("s.n_rows")).alias("log_loss"), "s.late")
        )

    def model(self, spark: SparkSession) -> online.OnlineModel:
        """The newest candidate."""
        state = self.before(spark, 1 << 62)
        return self.first if state is None else online.OnlineModel(np.array(state["weights"]), state["intercept"], state["step"])

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
