"""Isolation forest (Liu, Ting and Zhou, 2008) over the encoded contract features.

Trees are grown side by side on small samples, one task per tree; the forest (a bounded
number of nodes) is shipped to all tasks, which score Arrow batches with array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tontine import schemas as S
from tontine.functions.hashing import seeded_md5
from tontine.operators import encoding, scoring
from tontine.operators.ordering import exact_quantiles
from tontine.sources.shared import spool

N_TREES = 100
SAMPLE_ROWS = 256
#: Candidates of a tree per row it keeps, and the fewest rows that are reckoned with.
SPARE, LEAST_CANDIDATES = 2, 200
_NODES = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def tree_samples(encoded: DataFrame, key: str = "IDpol", trees: int = N_TREES, rows: int = SAMPLE_ROWS, seed: int = S.SEED) -> DataFrame:
    """``tree, key, v`` with ``rows`` distinct rows per tree, those of the whole table with the smallest hashes of the tree.

    In one pass a row goes to the trees whose hash of it is small enough for about ``SPARE * rows``
    candidates per tree; only these are ranked. Their number scatters by its root, so that fewer
    than ``rows`` are met once in 10^20 draws at most; the work after the pass does not depend on the table size.
    """
    total = encoded.count()
    share = min(1.0, SPARE * max(rows, LEAST_CANDIDATES) / max(total, 1))
    draw = lambda tree: F.xxhash64(F.lit(seed), tree, key)
    most = F.lit(2**63 - 1 if share == 1.0 else int(2**64 * share) - 2**63)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) <= most)
    candidates = encoded.select(key, "v", F.explode(drawn).alias("tree"))
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), key)
    return candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).select(key, "tree", "v")


def _grower(seed: int, key: str):
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        group = group.sort_values(key)
        points = np.vstack(group["v"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        nodes: list[list] = []
        waiting = [(np.arange(len(points)), 0, -1, False)]
        while waiting:
            members, depth, parent, is_left = waiting.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][4 if is_left else 5] = number
            low, high = points[members].min(axis=0), points[members].max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(varying) == 0:
                nodes.append([tree, number, -1, 0.0, -1, -1, len(members), depth])
                continue
            feature = int(rng.choice(varying))
            split = float(rng.uniform(low[feature], high[feature]))
            goes_left = points[members, feature] <= split
            nodes.append([tree, number, feature, split, -1, -1, len(members), depth])
            waiting.append((members[~goes_left], depth + 1, number, False))
            waiting.append((members[goes_left], depth + 1, number, True))
        return pd.DataFrame(nodes, columns=[part.split()[0] for part in _NODES.split(", ")])

    return grow


def grow_forest(encoded: DataFrame, key: str = "IDpol", seed: int = S.SEED, trees: int = N_TREES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Node table of the forest: at most ``trees * (2 * rows - 1)`` rows."""
    return tree_samples(encoded, key, trees, rows, seed).groupBy("tree").applyInPandas(_grower(seed, key), _NODES)


def score_forest(encoded: DataFrame, forest: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns plus ``anomaly_score`` in (0, 1); higher is more isolated."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    parts = []
    for _, tree in nodes.groupby("tree"):
        leaf_path = tree["depth"].to_numpy() + _mean_path(tree["size"].to_numpy())
        feature, number = tree["feature"].to_numpy().astype(np.int64), np.arange(len(tree))
        inner = feature >= 0
        # Right and left child of every node; a leaf is its own child, so all rows take as many steps as the tree is deep.
        children = np.stack([np.where(inner, tree[side].to_numpy(), number) for side in ("right", "left")], axis=1)
        parts.append(
            (
                np.maximum(feature, 0),
                tree["split"].to_numpy(),
                children.astype(np.int64).ravel(),
                leaf_path,
                int(tree["depth"].max()),
                int(tree["size"].max()),
            )
        )
    shared = encoded.sparkSession.sparkContext.broadcast(parts)
    fields = [f"`{name}` {kind}" for name, kind in encoded.select(*keep).dtypes]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_parts = shared.value
        normal = _mean_path(np.array([forest_parts[0][5]]))[0]
        for batch in batches:
            if batch.empty:
                continue
            points = np.vstack(batch["v"].to_numpy())
            first = np.arange(len(points)) * points.shape[1]
            values = points.ravel()
            total = np.zeros(len(points))
            for feature, split, children, leaf_path, depth, _ in forest_parts:
                at = np.zeros(len(points), dtype=np.int64)
                for _ in range(depth):
                    goes_left = values.take(first + feature.take(at)) <= split.take(at)
                    at = children.take(2 * at + goes_left)
                total += leaf_path.take(at)
            result = batch.drop(columns="v")
            result["anomaly_score"] = np.power(2.0, -total / (len(forest_parts) * max(normal, 1e-12)))
            yield result

    return encoded.select(*keep, "v").mapInPandas(score, ", ".join([*fields, "anomaly_score double"]))


def flag_scores(scores: DataFrame, contamination: float = S.ANOMALY_CONTAMINATION, score: str = "anomaly_score") -> DataFrame:
    """Flag the top share of scores: those above the exact interpolated quantile."""
    threshold = exact_quantiles(scores, [score], [1.0 - contamination]).select(F.col("quantiles")[0]).scalar()
    return scores.withColumn("anomaly_flag", (F.col(score) > threshold).cast("bigint"))


#: The form of a stored model; a reader refuses any other.
MODEL_VERSION = 1
_REPORT = "schema_version int, trees int, contamination double, threshold double, seed long"


class ModelFormatError(ValueError):
    """A stored model has a form that this reader does not know."""


@dataclass(frozen=True)
class AnomalyModel:
    """Encoder, node table and the score above which a contract is flagged; all that scoring needs."""

    encoder: PipelineModel
    forest: DataFrame
    trees: int
    contamination: float
    threshold: float | None
    seed: int

    def score(self, features: DataFrame) -> DataFrame:
        """``IDpol, pool_id, anomaly_score, anomaly_flag`` by the stored threshold."""
        inputs = scoring.model_inputs(features)
        dense = encoding.encode(inputs, self.encoder).select("IDpol", "pool_id", vector_to_array(encoding.FEATURES).alias("v"))
        scored = score_forest(dense, self.forest, ("IDpol", "pool_id"))
        flag = F.coalesce(F.col("anomaly_score") > F.lit(self.threshold).cast("double"), F.lit(False))
        return scored.withColumn("anomaly_flag", flag.cast("bigint"))

    def save(self, path: str) -> None:
        """Encoder, nodes and, last of all, the report that makes the model complete."""
        spark = self.forest.sparkSession
        self.encoder.write().overwrite().save(f"{path}/encoder")
        self.forest.write.mode("overwrite").parquet(f"{path}/nodes")
        report = [(MODEL_VERSION, self.trees, self.contamination, self.threshold, self.seed)]
        spark.createDataFrame(report, _REPORT).coalesce(1).write.mode("overwrite").json(f"{path}/report")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyModel":
        report = spark.read.schema(_REPORT).json(f"{path}/report").first()
        if report is None or report["schema_version"] != MODEL_VERSION:
            found = None if report is None else report["schema_version"]
            raise ModelFormatError(f"{path} holds an anomaly model of version {found}, not {MODEL_VERSION}")
        forest = spark.read.schema(_NODES).parquet(f"{path}/nodes")
        found = forest.agg(F.count_distinct("tree")).first()[0]
        if found != report["trees"]:
            raise ModelFormatError(f"{path} holds {found} trees of {report['trees']}")
        encoder = PipelineModel.load(f"{path}/encoder")
        return AnomalyModel(encoder, forest, report["trees"], report["contamination"], report["threshold"], report["seed"])


def fit_anomaly_model(
    features: DataFrame, contamination: float = S.ANOMALY_CONTAMINATION, seed: int = S.SEED, trees: int = N_TREES
) -> AnomalyModel:
    """A forest of the whole table and the threshold of its training scores."""
    inputs = scoring.model_inputs(features)
    encoder = encoding.fit_encoder(inputs)
    dense = encoding.encode(inputs, encoder).select("IDpol", vector_to_array(encoding.FEATURES).alias("v"))
    encoded = spool(dense, "anomaly-input")
    forest = spool(grow_forest(encoded, "IDpol", seed, trees), "forest")
    grown = forest.agg(F.count_distinct("tree")).first()[0]
    scores = spool(score_forest(encoded, forest, ("IDpol",)), "anomaly-scores") if grown else None
    row = exact_quantiles(scores, ["anomaly_score"], [1.0 - contamination]).first() if grown else None
    return AnomalyModel(encoder, forest, grown, contamination, row["quantiles"][0] if row else None, seed)


def anomaly_scores(
    features: DataFrame, contamination: float = S.ANOMALY_CONTAMINATION, seed: int = S.SEED, trees: int = N_TREES
) -> DataFrame:
    """``IDpol, pool_id, anomaly_score, anomaly_flag`` for all contracts."""
    inputs = scoring.model_inputs(features)
    encoder = encoding.fit_encoder(inputs)
    dense = encoding.encode(inputs, encoder).select(
        "IDpol", "pool_id", vector_to_array(encoding.FEATURES).alias("v")
    )
    encoded = spool(dense, "anomaly-input")
    forest = spool(grow_forest(encoded, "IDpol", seed, trees), "forest")
    scored = spool(score_forest(encoded, forest, ("IDpol", "pool_id")), "anomaly-scores")
    return flag_scores(scored, contamination)
