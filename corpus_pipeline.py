"""The corpus pipeline: documents in, training segmentations out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; what a stage returns is written as
Parquet to the shared folder and read again by the next. All but the last return the columns of ``documents``.

Defined results
* null and empty texts: scored like any text by the classifier; no line, no link, no leak; segmented into nothing;
* null ids: such rows stay in every stage that does not reject their text; repeated rows (id and text): one stays;
* ties: the smallest id of a group of near copies stays;
* an empty table passes through all stages; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine.llm import decontam, jaccard, linededup, pieces, quality
from tontine.llm.queries import held_out
from tontine.llm.registry import query, table, unused
from tontine.sources.shared import fresh_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of ``sf_dir`` and the texts of ``docs``."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return quality.keep(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text."""
    dropped = unused(docs, "dropped_lines")
    cleaned = linededup.clean(docs, dropped_name=dropped)
    if "n_chars" in docs.columns:
        changed = F.col(dropped) > 0
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard.keep_one(docs, jaccard.cluster(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left."""
    return pieces.encode(docs, remembered=1 << 15)  # executors still hold what earlier stages left


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", segmentation_stage),
]

#: The classifier and the sampler have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
