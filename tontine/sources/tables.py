"""Readers and sinks for the domain tables."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tontine import schemas as S
from tontine.operators import quality
from tontine.sources.lines import numbered_lines

CORRUPT = "_corrupt"


class SourceError(ValueError):
    """A required input is absent or has the wrong form."""


def _absent(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error.getCondition() or "") or "PATH_NOT_FOUND" in str(error)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """Header CSV with a declared schema; the header is checked before columns are bound.

    Only the header line is looked at for that, and columns may come in any order.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if _absent(error):
            raise SourceError(f"{name} table does not exist: {path}") from error
        raise
    if not header:
        raise SourceError(f"{name} table is empty: {path}")
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise SourceError(f"{name} is missing required columns: {', '.join(missing)}")
    known = {f.name: f.dataType for f in schema.fields}
    ordered = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    return spark.read.schema(ordered).option("header", True).csv(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, S.POLICIES, "frequency")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, S.CLAIMS, "severity")


def load_raw(spark: SparkSession, policies_path: str, claims_path: str) -> tuple[DataFrame, DataFrame]:
    """Both raw tables, checked for columns, rows and unique policy keys."""
    policies = read_policies(spark, policies_path)
    claims = read_claims(spark, claims_path)
    quality.expect_rows(policies, "frequency")
    quality.expect_rows(claims, "severity")
    quality.expect_unique(policies, "IDpol", "frequency")
    return policies, claims


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A table that may be absent: then it has no rows."""
    try:
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", True)
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if _absent(error):
            return spark.createDataFrame([], schema)
        raise


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stream batches, partitioned by ``batch_id``; none at all is an error."""
    try:
        batches = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if _absent(error):
            raise SourceError(f"no stream batches found in {path}") from error
        raise
    if batches.isEmpty():
        raise SourceError(f"no stream batches found in {path}")
    return batches


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """One batch by partition pruning; an absent one is an error."""
    batch = spark.read.schema(schema).parquet(path).filter(F.col("batch_id") == batch_id)
    if batch.isEmpty():
        raise SourceError(f"stream batch does not exist: {batch_id}")
    return batch


def write_batches(stream: DataFrame, path: str) -> None:
    """One partition folder per batch; adaptive execution splits batches that are too big."""
    stream.hint("rebalance", "batch_id").write.mode("overwrite").partitionBy("batch_id").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row audit report as JSON, nulls kept."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if _absent(error):
            raise SourceError(f"report does not exist: {path}") from error
        raise


def read_optional_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_optional(spark, path, schema, fmt="json")


def split_json_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed objects and the lines that are no JSON object; blank lines are skipped. Bad lines keep all their columns."""
    text = F.trim("value")
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = (
        lines.filter(text != "")
        .withColumn("record", F.from_json("value", with_corrupt, {"columnNameOfCorruptRecord": CORRUPT}))
    )
    is_object = text.startswith("{") & F.col("record").isNotNull() & F.col(f"record.{CORRUPT}").isNull()
    good = parsed.filter(is_object).select("record.*").drop(CORRUPT)
    bad = parsed.filter(~is_object).drop("record")
    return good, bad


def read_decision_log(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Decision records and quarantined lines of a JSON-lines log."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if _absent(error):
            return spark.createDataFrame([], S.DECISIONS), spark.createDataFrame([], "value string")
        raise
    good, bad = split_json_lines(lines, S.DECISIONS)
    if strict and not bad.isEmpty():
        where = broken_lines(spark, path).orderBy("path", "line").first()
        raise SourceError(f"{where['path']}, line {where['line']}: not a JSON object")
    return good, bad


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line``: where a decision log holds what is no JSON object."""
    return split_json_lines(numbered_lines(spark, path), S.DECISIONS)[1].select("path", "line")


#: What a sink raises when it cannot be written: Spark's own errors, those of the JVM behind it, and of the file system.
SINK_ERRORS = (PySparkException, Py4JError, OSError)


def append_decisions(decisions: DataFrame, path: str) -> int:
    """Append to the log; the number of failed writes is returned, never raised."""
    try:
        decisions.write.mode("append").option("ignoreNullFields", False).json(path)
    except SINK_ERRORS:  # a trace failure must not break scoring
        return 1
    return 0


def cycle_log_rows(cycles: DataFrame) -> DataFrame:
    """Fixed column order, nulls as empty strings."""
    return cycles.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in S.CYCLE_LOG_COLUMNS))


def write_cycle_log(cycles: DataFrame, path: str) -> None:
    cycle_log_rows(cycles).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def long_metrics(run: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``run_id, metric, value`` rows of a wide run row; null metrics are not logged."""
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return run.select(key, F.inline(cells)).filter(F.col("value").isNotNull())


def long_tags(run: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``run_id, tag, value`` rows; a null tag is logged as the empty string."""
    cells = F.array(
        *(F.struct(F.lit(n).alias("tag"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value")) for n in names)
    )
    return run.select(key, F.inline(cells))
