"""Quality by compression: a text is good if a dictionary of good text shortens it more than one of bad text.

Two zstandard dictionaries are trained, from good and from bad labelled text. A text is compressed chunk by chunk with
either; short chunks keep the dictionary in play to the end of a long text, and every byte is compressed. With g and b
the compressed sizes and n the bytes, the normalised difference d = (b - g) / n is calibrated by a logistic curve whose
second input is the rate r = g / n: it tells a text too short to differ (r near 1) from one that any dictionary
shortens to nothing (r near 0).

Training runs on a bounded sample of labelled rows: at most ``per_class`` documents of either class, chosen by a hash
of the id, at most ``chunks_per_document`` chunks of each; one part trains the dictionaries, the other the curve.

Defined results
* null and empty texts: d = 0, r = 1, so the curve's value there;
* rows with a null id are scored, but never train; ids with contradictory or null labels never train;
* without labels of both classes every score is the smoothed share of good labels, (good + 1) / (labels + 2);
* repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tontine.llm.arrowtools import arrow_schema, encoded, slices

CHUNK = 2048
LEVEL = 3
DICTIONARY_BYTES = 1 << 19
PER_CLASS = 6000
CHUNKS_PER_DOCUMENT = 4
SEED = 7
#: Every third document of the sample fits the curve.
CURVE_PART = 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries as bytes (raw: a plain prefix, not a trained dictionary) and the curve (constant, d, r)."""

    good: bytes
    bad: bytes
    raw: bool
    curve: tuple[float, float, float]


def compressors(model: CompressionModel) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_AUTO
    out = []
    for data in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
        dictionary.precompute_compress(level=LEVEL)
        out.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return out[0], out[1]


def sizes(text: bytes, good, bad) -> tuple[float, float]:
    """Normalised difference and rate of one whole text."""
    if not text:
        return 0.0, 1.0
    g = b = 0
    for start in range(0, len(text), CHUNK):
        piece = text[start : start + CHUNK]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / len(text), min(1.0, g / len(text))


def curve_value(curve: tuple[float, float, float], d: float, r: float) -> float:
    z = curve[0] + curve[1] * d + curve[2] * r
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def training_sample(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, chunks: int
) -> tuple[list[tuple[int, bytes, list[bytes]]], int, int]:
    """Bounded sample as (label, whole text or its chunks, chunks), and the label counts of all usable ids."""
    usable = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("id", "label", F.xxhash64("id", F.lit(SEED)).alias("draw"))
    )
    counts = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy("draw", "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * per_class ids: a proven bound for the broadcast.
    texts = documents.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), "id"
    )
    # Repeated ids: the text with the smallest hash, so no more rows than ids reach the driver.
    least = F.min_by(F.struct("text", "label", "draw"), F.coalesce(F.xxhash64("text"), F.lit(0)))
    texts = texts.groupBy("id").agg(least.alias("row")).select("id", "row.text", "row.label", "row.draw")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for body in encoded(batch.column("text")):
                starts = range(0, len(body or b""), CHUNK)
                step = max(1, len(starts) // chunks)
                pieces.append([body[s : s + CHUNK] for s in starts[::step][:chunks]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("label"), batch.column("draw"),
                 pa.array(pieces, pa.list_(pa.binary()))],
                names=["id", "label", "draw", "pieces"],
            )

    rows = texts.mapInArrow(cut, "id long, label int, draw long, pieces array<binary>").collect()
    rows.sort(key=lambda r: (r["draw"], r["id"], r["pieces"]))
    return [(r["label"], r["draw"], r["pieces"]) for r in rows], counts.get(1, 0), counts.get(0, 0)


def fit_curve(points: list[tuple[float, float, int]], rounds: int = 60, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Logistic curve by Newton steps; the slight ridge keeps it finite where the classes separate."""
    x = np.array([(1.0, d * 20.0, r) for d, r, _ in points])
    y = np.array([label for _, _, label in points], float)
    w = np.zeros(3)
    penalty = ridge * len(points) * np.diag([1e-3, 1.0, 1.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return float(w[0]), float(w[1] * 20.0), float(w[2])


def train_dictionaries(samples: dict[int, list[bytes]], size: int) -> tuple[bytes, bytes, bool]:
    """Trained dictionaries, or plain prefixes where the samples are too few to train from."""
    try:
        made = {value: zstandard.train_dictionary(size, samples[value]).as_bytes() for value in (1, 0)}
        return made[1], made[0], False
    except zstandard.ZstdError:
        return b"".join(samples[1])[-size:] or b" ", b"".join(samples[0])[-size:] or b" ", True


def train(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = PER_CLASS,
    chunks_per_document: int = CHUNKS_PER_DOCUMENT,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> CompressionModel:
    rows, good, bad = training_sample(documents, labels, key, text, label, per_class, chunks_per_document)
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    curve_rows = []
    for n, (value, _, pieces) in enumerate(rows):
        if n % CURVE_PART == 0:
            curve_rows.append((value, b"".join(pieces)))
        else:
            parts[value].extend(pieces)
    if not parts[0] or not parts[1] or len({value for value, _ in curve_rows}) < 2:
        share = (good + 1) / (good + bad + 2)
        return CompressionModel(b" ", b" ", True, (math.log(share / (1 - share)), 0.0, 0.0))
    for value in parts:
        random.Random(SEED).shuffle(parts[value])
    size = min(dictionary_bytes, max(1024, min(sum(map(len, p)) for p in parts.values()) // 8))
    draft = CompressionModel(*train_dictionaries(parts, size), (0.0, 0.0, 0.0))
    pair = compressors(draft)
    points = [(*sizes(body, *pair), value) for value, body in curve_rows]
    constant, slope, rate = fit_curve(points)
    # The sample is cut per class; the constant is moved back to the odds of all labels.
    drawn = sum(value for value, _ in curve_rows)
    constant += math.log(good / bad) - math.log(drawn / (len(curve_rows) - drawn))
    return CompressionModel(draft.good, draft.bad, draft.raw, (constant, slope, rate))


SCORES = "key long, d double, r double, score double"


def score(documents: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, d, r, score`` of every row. The model is two dictionaries of bounded size, broadcast once."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(shared.value)
        for batch in slices(batches, 1):
            found = [sizes(body or b"", *pair) for body in encoded(batch.column("text"))]
            values = [curve_value(shared.value.curve, d, r) for d, r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([d for d, _ in found], pa.float64()),
                 pa.array([r for _, r in found], pa.float64()), pa.array(values, pa.float64())],
                schema=arrow_schema(SCORES),
            )

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCORES)


def keep(documents: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, that score ``threshold`` or more; decided in the scan, without a join."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    position = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(shared.value)
        for batch in slices(batches, position):
            found = (sizes(body or b"", *pair) for body in encoded(batch.column(position)))
            yield batch.filter(pa.array([curve_value(shared.value.curve, d, r) >= threshold for d, r in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
