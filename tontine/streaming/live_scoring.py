"""Live scoring: validated requests become probabilities, decisions and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tontine import schemas as S
from tontine.functions.hashing import keyed_fingerprint
from tontine.operators import features, lineage, quality, scoring
from tontine.sources import tables


def score_contracts(requests: DataFrame, scorer: scoring.Scorer, keep: tuple[str, ...] = ("request_id",)) -> tuple[DataFrame, DataFrame]:
    """Scored requests and rejected ones. Stateless: works on tables and streams alike.

    Features come from the function that built the training features.
    """
    quality.expect_columns(requests, (*keep, *S.SERVING_COLUMNS), "scoring requests")
    accepted, rejected = quality.split_requests(requests, list(keep))
    derived = features.with_derived(accepted)
    return scorer(derived), rejected


def _identity(endpoint: str, model: dict[str, str | None]) -> list[Column]:
    """What a decision record says of its request and of the model behind it."""
    text = lambda key: F.lit(model.get(key)).cast("string").alias(key)
    return [
        F.sha2(F.concat_ws(":", F.lit("decision"), F.col("request_id").cast("string")), 256).alias("decision_id"),
        F.col("request_id").cast("string").alias("request_id"),
        F.lit(endpoint).alias("endpoint"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp_utc"),
        text("model_source"),
        text("model_artifact_path"),
        text("model_artifact_sha256"),
        text("retraining_cycle_id"),
        text("dvc_output_hash"),
        text("dataset_git_commit_sha"),
    ]


def contract_decisions(
    scored: DataFrame, model: dict[str, str | None], policy: lineage.TracePolicy, fingerprint_columns: tuple[str, ...] = S.SERVING_COLUMNS
) -> DataFrame:
    """Decision records of single-contract requests; none where tracing is disabled."""
    if not policy.enabled:
        return scored.sparkSession.createDataFrame([], S.DECISIONS)
    fingerprint = lineage.request_fingerprint(policy, *fingerprint_columns)
    rows = scored.select(
        *_identity("/score/contract", model),
        F.lit(1).cast("bigint").alias("contract_count"),
        F.col(S.PROBABILITY).alias("mean_probability"),
        F.lit(None).cast("double").alias("pool_risk_score"),
        F.col("Exposure").cast("double").alias("pool_scored_exposure"),
        F.lit(None).cast("string").alias("pool_score_weighting_method"),
        fingerprint.alias("input_fingerprint"),
        F.lit(policy.salt_mode).alias("trace_salt_mode"),
    )
    return lineage.decision_rows(rows)


def pool_decisions(members: DataFrame, scorer: scoring.Scorer) -> tuple[DataFrame, DataFrame]:
    """Pool scores per request from its member rows, and the rejected requests.

    A request is rejected as a whole if a member is invalid or of another pool.
    """
    checked = quality.classify_requests(members)
    verdict = checked.groupBy("request_id", "request_pool_id").agg(
        F.bool_or(F.size("rejected_rules") > 0).alias("invalid_member"),
        F.bool_or(F.coalesce(F.col("pool_id").cast("string") != F.col("request_pool_id"), F.lit(True))).alias("foreign_member"),
    )
    rejected = verdict.filter("invalid_member OR foreign_member")
    kept = members.join(rejected.select("request_id"), "request_id", "left_anti")
    scored = scorer(features.with_derived(kept))
    return scoring.pool_risk_scores(scored, by="request_id"), rejected


REQUEST_ROW = ("request_id", *S.SERVING_COLUMNS)
MEMBER_ROW = ("request_id", "request_pool_id", "contract_count", "member_index", *S.SERVING_COLUMNS)


def pool_decision_records(
    scores: DataFrame, members: DataFrame, model: dict[str, str | None], policy: lineage.TracePolicy
) -> DataFrame:
    """Decision records of scored pool requests; none where tracing is disabled.

    The fingerprint is keyed over the fingerprints of all members in order of ``member_index``: they are hashed per row,
    so only 64 characters a member meet in a request.
    """
    if not policy.enabled:
        return scores.sparkSession.createDataFrame([], S.DECISIONS)
    request = F.col("request_id").cast("string").alias("request_id")
    each = members.select(request, "member_index", lineage.request_fingerprint(policy, *S.SERVING_COLUMNS).alias("f"))
    parts = each.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("member_index", "f"))).alias("parts"))
    payload = F.array_join(F.transform("parts", lambda part: part["f"]), ",")
    whole = parts.select("request_id", keyed_fingerprint(payload, policy.salt).alias("fingerprint"))
    rows = scores.join(whole, "request_id").select(
        *_identity("/score/pool", model),
        F.col("pool_contract_count").cast("bigint").alias("contract_count"),
        "mean_probability",
        "pool_risk_score",
        "pool_scored_exposure",
        "pool_score_weighting_method",
        F.col("fingerprint").alias("input_fingerprint"),
        F.lit(policy.salt_mode).alias("trace_salt_mode"),
    )
    return lineage.decision_rows(rows)


class LiveScoring:
    """Writes scores, decisions and rejects of each micro-batch.

    Each sink is partitioned by the micro-batch number and that partition is overwritten,
    so a replayed micro-batch leaves no duplicates. Decisions carry no request values. A
    decision sink that cannot be written is counted and never stops scoring.
    """

    def __init__(
        self, scorer: scoring.Scorer, model: dict[str, str | None], policy: lineage.TracePolicy, root: str,
        decision_log: str | None = None,
    ):
        self.scorer, self.model, self.policy, self.root = scorer, model, policy, root
        self.decision_log = decision_log or f"{root}/decisions"

    def _put(self, df: DataFrame, name: str, epoch: int) -> None:
        self._partition(df, epoch).parquet(f"{self.root}/{name}")

    def _partition(self, df: DataFrame, epoch: int):
        dated = df.withColumn("epoch", F.lit(epoch).cast("long"))
        return dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")

    def _trace(self, decisions: DataFrame, endpoint: str, epoch: int) -> None:
        """Decisions as JSON lines; a failure becomes a row of ``failures`` with the kind of the error, not its message."""
        failed: list[tuple[str, str]] = []
        try:
            self._partition(decisions, epoch).option("ignoreNullFields", False).json(self.decision_log)
        except tables.SINK_ERRORS as error:
            failed.append((endpoint, type(error).__name__))
        table = decisions.sparkSession.createDataFrame(failed, "endpoint string, error_type string")
        self._put(table.coalesce(1), "failures", epoch)

    def process(self, requests: DataFrame, epoch: int) -> None:
        quality.expect_known_fields(requests, REQUEST_ROW)
        scored, rejected = score_contracts(requests, self.scorer)
        self._put(scored.select("request_id", "pool_id", S.PROBABILITY), "scores", epoch)
        self._put(rejected, "rejects", epoch)
        if self.policy.enabled:
            self._trace(contract_decisions(scored, self.model, self.policy), "/score/contract", epoch)

    def decisions(self, spark: SparkSession) -> DataFrame:
        """The decision records written so far."""
        return tables.read_decision_log(spark, self.decision_log)[0]

    def trace_log_failures(self, spark: SparkSession) -> DataFrame:
        """``trace_log_failures_total`` over all micro-batches, one row."""
        failures = tables.read_optional(spark, f"{self.root}/failures", FAILURES, "parquet")
        return failures.agg(F.count(F.lit(1)).alias("trace_log_failures_total"))

    def start(self, requests: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        quality.expect_known_fields(requests, self.fields)
        writer = requests.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    #: The fields a request may have.
    fields: tuple[str, ...] = REQUEST_ROW


FAILURES = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("error_type", T.StringType())])


class LivePools(LiveScoring):
    """Pool requests whose member rows may arrive over several micro-batches.

    A request is complete once ``contract_count`` different members are there. What is not yet complete is the state: it is
    written under the epoch, and the next epoch reads it from there, so a replayed micro-batch starts from the same rows.
    A member that arrives twice counts once; a request that states no count is complete with what one micro-batch holds.
    Requests are accepted or rejected as a whole.
    """

    fields = MEMBER_ROW

    def _waiting(self, spark: SparkSession, epoch: int, schema: T.StructType) -> DataFrame:
        """Members that the last finished epoch left over."""
        stored = tables.read_optional(spark, f"{self.root}/waiting", schema.add("epoch", T.LongType()), "parquet")
        done = tables.read_optional(spark, f"{self.root}/epochs", T.StructType().add("n_requests", T.LongType()).add("epoch", T.LongType()), "parquet")
        last = done.filter(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
        return stored.filter(F.col("epoch") == last).drop("epoch")

    def process(self, members: DataFrame, epoch: int) -> None:
        quality.expect_known_fields(members, MEMBER_ROW)
        spark = members.sparkSession
        arrived = members.select(*MEMBER_ROW)
        left = self._waiting(spark, epoch, T.StructType(list(arrived.schema.fields)))
        pending = left.unionByName(arrived).dropDuplicates(["request_id", "member_index"]).persist()
        try:
            counts = pending.groupBy("request_id").agg((F.count(F.lit(1)) >= F.coalesce(F.max("contract_count"), F.lit(0))).alias("complete"))
            whole = pending.join(counts.filter("complete").select("request_id"), "request_id", "left_semi")
            scores, rejected = pool_decisions(whole, self.scorer)
            self._put(scores, "scores", epoch)
            self._put(rejected, "rejects", epoch)
            if self.policy.enabled:
                self._trace(pool_decision_records(scores, whole, self.model, self.policy), "/score/pool", epoch)
            self._put(pending.join(counts.filter("complete").select("request_id"), "request_id", "left_anti"), "waiting", epoch)
            self._put(counts.agg(F.count_if("complete").alias("n_requests")).coalesce(1), "epochs", epoch)  # last: the epoch is done
        finally:
            pending.unpersist()
