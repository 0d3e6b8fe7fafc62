"""Digests of rows and of text files as hash trees, manifests of what the sinks write, and the dataset version report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.sources.lines import numbered_lines
from tontine.sources.tables import SourceError


#: Absent paths that an error message spells out.
NAMED_PATHS = 100


def expected_artifacts(spark: SparkSession, n_batches: int = S.N_BATCHES) -> DataFrame:
    """Relative paths of a complete processed dataset."""
    # The artifact names of a processed dataset.
    names = (
        "ingestion_report.json",
        "cleaning_report.json",
        "freMTPL2freq_cleaned.csv",
        "freMTPL2sev_cleaned.csv",
        "freMTPL2freq_pooled.csv",
        "pool_construction_report.json",
        "contract_features.csv",
        "contract_targets.csv",
        "pool_features.csv",
        "pool_targets.csv",
        "feature_engineering_report.json",
        "stream/stream_simulation_report.json",
        "stream/drift_ground_truth.json",
    )
    fixed = spark.createDataFrame([(n,) for n in names], "path string")
    batches = spark.range(n_batches).select(F.format_string("stream/batch_%03d.csv", "id").alias("path"))
    return fixed.unionByName(batches)


def manifest_check(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected paths that are not there."""
    return expected.join(present, "path", "left_anti")


def expect_manifest(expected: DataFrame, present: DataFrame, allow_missing: bool = False) -> DataFrame:
    missing = manifest_check(expected, present)
    if not allow_missing:
        absent = missing.count()
        if absent:
            # The message names the first ones; the table with all of them is the return value of ``manifest_check``.
            first = [row["path"] for row in missing.orderBy("path").limit(NAMED_PATHS).collect()]
            raise SourceError(f"{absent} artifacts of the manifest are not in the dataset, first {', '.join(first)}")
    return missing


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical text of a row: columns by name, each value as its length and its text, null as a dash.

    Floating-point values have nine decimals, all else is Spark's text of it; no two different rows share a text.
    """

    def cell(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        text = F.format_string("%.9f", value.cast("double")) if kind in ("double", "float") else value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    wanted = set(columns or df.columns)
    return F.concat_ws(",", *(cell(n, k) for n, k in sorted(df.dtypes) if n in wanted))


#: A leaf of the tree holds about so many rows when the number of levels is derived.
LEAF_ROWS = 4096


def tree_levels(rows: int) -> int:
    """Hex digits that name a leaf: 16 leaves a level."""
    levels = 0
    while rows > LEAF_ROWS * 16**levels:
        levels += 1
    return levels


def content_digests(df: DataFrame, by: Sequence[str] = (), levels: int | None = None) -> DataFrame:
    """``by, n_rows, digest``: one digest of all rows per value of ``by``, whatever files, order and partitions they lie in.

    Rows are hashed where they are read. A leaf is the set of row digests with the same first ``levels`` hex digits, hashed
    in order; every level above hashes 16 digests, so no task gathers more than a leaf. Repeated rows count. ``levels``
    follows the row count unless it is given, and is part of what a digest means.
    """
    if levels is None:
        levels = tree_levels(df.count())
    own = [c for c in df.columns if c not in by]
    rows = df.select(*by, F.sha2(row_text(df, own), 256).alias("d"))
    tree = rows.groupBy(*by, F.substring("d", 1, levels).alias("p")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ","), 256).alias("d"), F.count(F.lit(1)).alias("n")
    )
    for level in range(levels - 1, -1, -1):
        below = F.sort_array(F.collect_list(F.struct("p", "d")))
        tree = tree.groupBy(*by, F.substring("p", 1, level).alias("p")).agg(
            F.sha2(F.array_join(F.transform(below, lambda x: x["d"]), ","), 256).alias("d"), F.sum("n").alias("n")
        )
    return tree.select(*by, F.col("n").alias("n_rows"), F.col("d").alias("digest"))


#: Lines of a text file that one leaf of its tree holds.
CHUNK_LINES = 4096


def text_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, n_lines, sha256`` of every text file, read in splits: a file of any size works, no file is one row.

    The digest is that of the digests of its runs of 4,096 lines, so it does not depend on how files are split.
    """
    lines = numbered_lines(spark, path)
    chunks = lines.groupBy("path", F.floor((F.col("line") - 1) / CHUNK_LINES).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("line", "value"))).alias("lines"), F.count(F.lit(1)).alias("n")
    )
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    leaves = chunks.select("path", "chunk", "n", F.sha2(text, 256).alias("d"))
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "d")))
    return leaves.groupBy("path").agg(
        F.sum("n").alias("n_lines"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), ","), 256).alias("sha256")
    )


MANIFEST = "unit string, n_rows bigint, digest string"


def manifest_of(df: DataFrame, name: str, by: str | None = None, levels: int | None = None) -> DataFrame:
    """``unit, n_rows, digest``: a row per partition folder of a table (``name/by=value``), or one for an undivided table."""
    digests = content_digests(df, [by] if by else [], levels)
    unit = F.concat(F.lit(f"{name}/{by}="), F.col(by).cast("string")) if by else F.lit(name)
    return digests.select(unit.alias("unit"), "n_rows", "digest")


def write_manifest(manifest: DataFrame, root: str) -> None:
    """The last thing that is written of a dataset: with it, the dataset is complete."""
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest")


def manifest_status(written: DataFrame, present: DataFrame) -> DataFrame:
    """``unit, status, n_rows``: ``same``, ``changed``, ``missing`` (written, not there) or ``unlisted``; rows as written."""
    found = present.select("unit", F.col("n_rows").alias("rows_now"), F.col("digest").alias("digest_now"))
    joined = written.join(found, "unit", "full")
    status = (
        F.when(F.col("digest").isNull(), F.lit("unlisted"))
        .when(F.col("digest_now").isNull(), F.lit("missing"))
        .when((F.col("digest") == F.col("digest_now")) & (F.col("n_rows") == F.col("rows_now")), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return joined.select("unit", status.alias("status"), "n_rows")


def expect_complete(status: DataFrame) -> None:
    """Refuse a dataset that is not what its manifest says."""
    wrong = status.filter("status <> 'same'").orderBy("status", "unit")
    named = [f"{r['unit']} is {r['status']}" for r in wrong.limit(NAMED_PATHS).collect()]
    if named:
        raise SourceError("the dataset differs from its manifest: " + ", ".join(named))


def artifact_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file under a folder, hashed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot_digest(digests: DataFrame) -> DataFrame:
    """One digest of a set of files, independent of listing order.

    Files are folded into 256 groups by digest prefix first; groups hold file digests
    (not contents), so even a million-file snapshot stays at a few thousand per group.
    """
    groups = digests.groupBy(F.substring("sha256", 1, 2).alias("g")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ","), 256).alias("group_digest"),
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
    )
    return groups.agg(
        F.sha2(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("g", "group_digest"))), lambda x: x["group_digest"]),
                ",",
            ),
            256,
        ).alias("snapshot_digest"),
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
    )


def relative_paths(digests: DataFrame, root: str) -> DataFrame:
    bare = root.split(":", 1)[-1].lstrip("/").rstrip("/")
    return digests.select(F.regexp_replace("path", rf"^.*?{bare}/", "").alias("path"))


def dataset_version_report(spark: SparkSession, root: str, n_batches: int = S.N_BATCHES, allow_missing: bool = False) -> DataFrame:
    """Snapshot digest with the counts of expected and missing artifacts."""
    digests = artifact_digests(spark, root)
    expected = expected_artifacts(spark, n_batches)
    missing = expect_manifest(expected, relative_paths(digests, root), allow_missing)
    return snapshot_digest(digests).withColumns(
        {
            "expected_artifacts": expected.agg(F.count(F.lit(1))).scalar(),
            "missing_artifacts": missing.agg(F.count(F.lit(1))).scalar(),
            "generated_at_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        }
    )
