"""Input checks. Each returns counts or violating rows; ``expect_*`` forms raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tontine import schemas as S


class DataQualityError(ValueError):
    """An input breaks its contract."""


def expect_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    present = set(df.columns)
    missing = [column for column in columns if column not in present]
    if missing:
        raise DataQualityError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def expect_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise DataQualityError(f"{name} has no rows")
    return df


def duplicate_key_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key; a null key counts as one key."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
            F.count(F.lit(1)).cast("bigint").alias("key_count"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        )
    )


def expect_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    duplicates = duplicate_key_count(df, key).first()["duplicate_count"]
    if duplicates:
        raise DataQualityError(f"{name} contains {duplicates} duplicate {key} values")
    return df


def _missing(df: DataFrame, column: str) -> Column:
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(column)
    return missing


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, null_count`` for the given columns, from one aggregate pass."""
    counts = df.agg(*(F.count_if(_missing(df, c)).alias(c) for c in columns))
    rows = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns)
    )
    return counts.select(F.inline(rows))


def expect_no_nulls(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    counts = df.agg(*(F.count_if(_missing(df, c)).alias(c) for c in columns)).first()
    bad = [c for c in columns if counts[c]]
    if bad:
        raise DataQualityError(f"{name} must not contain missing values: {', '.join(bad)}")
    return df


def binary_domain(df: DataFrame, column: str) -> DataFrame:
    """Whether a label is 0/1 with at least two rows of each class."""
    per_value = df.groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    return per_value.agg(
        F.coalesce(F.bool_and(F.when(known, F.col("value").isin(0, 1))), F.lit(True)).alias("is_binary"),
        F.count_if(known).alias("class_count"),
        F.coalesce(F.min(F.when(known, F.col("n"))), F.lit(0)).cast("bigint").alias("smallest_class"),
    ).withColumn(
        "domain_ok",
        F.col("is_binary") & (F.col("class_count") == 2) & (F.col("smallest_class") >= 2),
    )


def expect_binary(df: DataFrame, column: str) -> DataFrame:
    result = binary_domain(df, column).first()
    if not result["is_binary"]:
        raise DataQualityError(f"{column} must be binary 0/1")
    if not result["domain_ok"]:
        raise DataQualityError(f"{column} holds fewer than two rows of one class")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Duplicates on either side and keys that only one side has.

    Both sides are counted per key before they meet, so a key that dominates a side
    travels as one row.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    joined = a.withColumnRenamed(key, "_k").join(
        b.withColumnRenamed(key, "_rk"), F.col("_k").eqNullSafe(F.col("_rk")), "full_outer"
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return joined.agg(
        total(F.col("left_rows") - 1).alias("left_duplicates"),
        total(F.col("right_rows") - 1).alias("right_duplicates"),
        F.count_if(F.col("right_rows").isNull()).alias("left_only"),
        F.count_if(F.col("left_rows").isNull()).alias("right_only"),
    ).withColumn(
        "one_to_one",
        (F.col("left_duplicates") + F.col("right_duplicates") + F.col("left_only") + F.col("right_only")) == 0,
    )


def expect_one_to_one(left: DataFrame, right: DataFrame, key: str, name: str) -> None:
    if not one_to_one(left, right, key).first()["one_to_one"]:
        raise DataQualityError(f"{name} must join one-to-one by {key}")


def reference_window(df: DataFrame, first: int = S.REFERENCE_FIRST_BATCH, last: int = S.REFERENCE_LAST_BATCH) -> DataFrame:
    """The reference batches must be free of injected drift and hold both classes."""
    return (
        df.filter(F.col("batch_id").between(first, last))
        .agg(
            F.count(F.lit(1)).alias("reference_rows"),
            F.coalesce(F.bool_or(F.col("data_drift_injected") | F.col("concept_drift_injected")), F.lit(False)).alias(
                "has_injected_drift"
            ),
            F.count_distinct(S.TARGET).alias("class_count"),
        )
        .withColumn("window_ok", ~F.col("has_injected_drift") & (F.col("class_count") >= 2))
    )


def batch_coverage(df: DataFrame, n_batches: int) -> DataFrame:
    """Expected batches with their row counts; an absent batch has zero rows."""
    expected = df.sparkSession.range(n_batches).select(F.col("id").cast("int").alias("batch_id"))
    counts = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"))
    return (
        expected.join(counts, "batch_id", "left")
        .select("batch_id", F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
        .withColumn("covered", F.col("row_count") > 0)
    )


def expect_batches(df: DataFrame, last_reference: int = S.REFERENCE_LAST_BATCH) -> None:
    """More batches than the reference window plus one, numbered without gaps."""
    row = df.agg(F.max("batch_id").alias("last"), F.count_distinct("batch_id").alias("n")).first()
    if row["last"] is None or row["n"] <= last_reference + 1:
        raise DataQualityError(f"nothing to monitor: batches end with the reference window (0..{last_reference})")
    if row["n"] != row["last"] + 1:
        raise DataQualityError(f"batch numbers reach {row['last']}, but only {row['n']} batches exist")


def expect_monitorable(
    df: DataFrame, first: int = S.REFERENCE_FIRST_BATCH, last: int = S.REFERENCE_LAST_BATCH
) -> DataFrame:
    """What a monitor needs of its stream, in one pass: batches without gaps beyond a clean reference window of both classes."""
    inside = F.col("batch_id").between(first, last)
    row = df.agg(
        F.max("batch_id").alias("last"),
        F.count_distinct("batch_id").alias("n"),
        F.bool_or(inside & (F.col("data_drift_injected") | F.col("concept_drift_injected"))).alias("injected"),
        F.count_distinct(F.when(inside, F.col(S.TARGET))).alias("classes"),
    ).first()
    if row["last"] is None or row["n"] <= last + 1:
        raise DataQualityError(f"nothing to monitor: batches end with the reference window ({first}..{last})")
    if row["n"] != row["last"] + 1:
        raise DataQualityError(f"batch numbers reach {row['last']}, but only {row['n']} batches exist")
    if row["injected"]:
        raise DataQualityError(f"the reference window ({first}..{last}) holds injected drift")
    if row["classes"] < 2:
        raise DataQualityError(f"the reference window ({first}..{last}) holds {row['classes']} of 2 classes")
    return df


def classify_requests(df: DataFrame) -> DataFrame:
    """Add ``rejected_rules``: names of broken request rules, never the offending values."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in S.SERVING_STRINGS]
    for c in S.SERVING_NUMERIC:
        value = F.col(c)
        rules.append(
            F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(f"missing:{c}")).when(
                value < 0, F.lit(f"negative:{c}")
            )
        )
    return df.withColumn("rejected_rules", F.filter(F.array(*rules), lambda rule: rule.isNotNull()))


def split_requests(df: DataFrame, id_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in full; rejected rows as identifiers and rule names only."""
    checked = classify_requests(df)
    accepted = checked.filter(F.size("rejected_rules") == 0).drop("rejected_rules")
    rejected = checked.filter(F.size("rejected_rules") > 0).select(*id_columns, "rejected_rules")
    return accepted, rejected


def expect_known_fields(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    unknown = [c for c in df.columns if c not in set(allowed)]
    if unknown:
        raise DataQualityError(f"unknown request fields: {', '.join(unknown)}")
    return df


def pool_membership(df: DataFrame, request: str = "request_id", declared: str = "request_pool_id") -> DataFrame:
    """Per request: member count and whether every member is of the declared pool."""
    return df.groupBy(request, declared).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.bool_and(F.coalesce(F.col("pool_id").cast("string") == F.col(declared).cast("string"), F.lit(False))).alias(
            "members_ok"
        ),
    )


def guard_clustering(k_min: int, k_max: int, sample_size: int, n_rows: int) -> None:
    if k_min < 2:
        raise DataQualityError(f"the smallest number of pools is 2, got k_min={k_min}")
    if k_max < k_min:
        raise DataQualityError(f"the scan from {k_min} to {k_max} is empty")
    if k_max >= n_rows:
        raise DataQualityError(f"{n_rows} rows cannot form k_max={k_max} pools")
    if sample_size < 2:
        raise DataQualityError(f"a silhouette over {sample_size} rows is undefined")


def guard_batches(n_batches: int, n_rows: int, data_start: int, concept_start: int) -> None:
    if n_batches < 1:
        raise DataQualityError(f"cannot deal rows into {n_batches} batches")
    if n_batches > n_rows:
        raise DataQualityError(f"{n_batches} batches asked of {n_rows} rows")
    for name, start in (("data", data_start), ("concept", concept_start)):
        if not 0 <= start < n_batches:
            raise DataQualityError(f"{name} drift starts at batch {start}, outside 0..{n_batches - 1}")


def guard_leakage(columns: Sequence[str]) -> None:
    leaked = [c for c in columns if c in S.OUTCOME_COLUMNS]
    if leaked:
        raise DataQualityError(f"outcome columns must not be model inputs: {', '.join(leaked)}")
