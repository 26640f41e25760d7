"""Naive Bayes support vectors: a linear quality classifier over n-gram indicators.

Indicators of words, word pairs, pairs of word shapes and byte triples are hashed into a table, scaled
by their log-count ratios between the classes, and a hinge-loss model is fitted
to them by dual coordinate descent. Only a bounded sample of labelled rows is
used for that; every text is scored whole, where it lies.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.hashing import U, mix, words_of_rows
from plumbline.llm.tables import small_batches, text_bytes, trimmed, whole_text

BITS = 18
# Labelled rows per class the model is fitted on: those with the least id hash.
SAMPLE_PER_CLASS = 1_000
ROUNDS = 20
COST = 1.0
# How far weights are drawn from their mean towards the fitted model.
BLEND = 0.9
# Kinds of bytes that make up a word's shape: other ASCII, a-z, A-Z, 0-9, the rest.
_KIND = np.zeros(256, np.uint32)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
# Bytes of one text whose indicators are hashed at a time.
PIECE = 1 << 20


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text."""
    data = np.frombuffer(text, np.uint8)
    shift = U(64 - BITS)
    found = [np.zeros(0, np.uint32)]
    words, begin, end, _ = words_of_rows(np.array([0, len(data)]), data)
    if len(words):
        found.append((mix(words + U(1)) >> shift).astype(np.uint32))
    if len(words) > 1:
        found.append((mix(words[:-1] * U(3) + words[1:]) >> shift).astype(np.uint32))
        # kinds of the first, second and last byte of both words, and whether they are the same word
        kinds = _KIND[data]
        shape = kinds[begin] * 25 + kinds[np.minimum(begin + 1, end - 1)] * 5 + kinds[end - 1]
        pair = (shape[:-1] * 125 + shape[1:]) * 2 + (words[1:] == words[:-1])
        found.append((mix(np.unique(pair).astype(U) + U(1 << 40)) >> shift).astype(np.uint32))
    for at in range(0, len(data) - 2, PIECE):
        part = data[at : at + PIECE + 2].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        found.append(code if len(code) < 4096 else np.unique(code))
    merged = np.sort(np.concatenate(found))
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged


@dataclass
class Model:
    """Weights of the indicators before and after scaling, and the calibration of margins."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        ratio = self.ratio[features]
        size = float(np.sqrt(np.dot(ratio, ratio)))
        return self.bias + (float(np.dot(self.weight[features], ratio)) / size if size else 0.0)

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for features, label in zip(rows, good):
        counts[int(label), features] += 1  # indicators are distinct within a row
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, rounds: int = ROUNDS, cost: float = COST
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: one dual variable is solved exactly at a time."""
    weight, bias = np.zeros(1 << BITS), 0.0
    values = []
    for features in rows:
        v = ratio[features]
        size = np.sqrt(np.dot(v, v))
        values.append((v / size if size else v).astype(np.float32))
    sign = np.where(good, 1.0, -1.0)
    norm = np.array([np.dot(v, v) + 1.0 for v in values])
    # both classes weigh the same
    share = np.array([(sign == s).mean() for s in (-1.0, 1.0)])
    most = cost * 0.5 / share[(sign > 0).astype(int)]
    dual = np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            gradient = sign[i] * (np.dot(weight[rows[i]], values[i]) + bias) - 1.0
            new = min(max(dual[i] - gradient / norm[i], 0.0), most[i])
            step = new - dual[i]
            if step:
                dual[i] = new
                weight[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    size = np.abs(weight).mean()
    return (1 - BLEND) * size + BLEND * weight, bias


def calibrate(margins: np.ndarray, good: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton's method.

    Classes count by ``prior``, the share of good rows among all labels, whatever
    their share in the sample.
    """
    x = np.column_stack([margins, np.ones(len(margins))])
    weight = np.where(good, prior / max(good.mean(), 1e-9), (1 - prior) / max(1 - good.mean(), 1e-9))
    target = np.where(good, 0.98, 0.02)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (at - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray, prior: float) -> Model:
    """A model from indicators and labels; with one class only it has no weights and scores by the class."""
    if len(rows) == 0 or good.all() or not good.any():
        none = np.zeros(1 << BITS, np.float32)
        return Model(none, none, 0.0, 1.0, float(np.log(prior / (1 - prior))))
    # every fourth row calibrates the model fitted on the others
    held = np.arange(len(rows)) % 4 == 0
    if good[held].all() or not good[held].any() or good[~held].all() or not good[~held].any():
        held[:] = False
    fitted = [r for r, h in zip(rows, held) if not h]
    ratio = log_count_ratios(fitted, good[~held])
    weight, bias = dual_coordinate_descent(fitted, good[~held], ratio)
    model = Model(ratio.astype(np.float32), weight.astype(np.float32), bias, 1.0, 0.0)
    check = held if held.any() else ~held
    margins = np.array([model.margin(r) for r, h in zip(rows, check) if h])
    model.slope, model.offset = calibrate(margins, good[check], prior)
    return model


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3. NULL ids are not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """Fit on the labelled rows that are not held out, SAMPLE_PER_CLASS of each class at most.

    A label counts if it is 0 or 1 and all rows of its id agree.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id"))
    marks = marks.where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    marks = marks.where("y = z").select("id", "y", F.xxhash64(F.col("id").cast("string"), F.lit("sample")).alias("draw"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows at most
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picked = [marks.where(F.col("y") == y).orderBy("draw", "id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    sample = picked[0].unionAll(picked[1]).select("id", "y", "draw")
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    # at most 2 * SAMPLE_PER_CLASS ids
    rows = texts.join(F.broadcast(sample), "id").mapInArrow(_indicator_rows, "y int, draw long, features binary")
    with small_batches(docs.sparkSession):
        made = rows.repartition(1).mapInArrow(_fit_task(prior), "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], np.zeros(0, bool), prior)


def _fit_task(prior: float):
    """Fit on the bounded sample in one task; only the model goes to the driver."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("draw", "features", "y")))]
        rows.sort()
        features = [np.frombuffer(f, np.uint32) for _, f, _ in rows]
        model = fit(features, np.array([y == 1 for *_, y in rows], bool), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return work


@trimmed
def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        made = [indicators(data[a:b].tobytes()).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), batch.column("draw"), pa.array(made, pa.binary())], ["y", "draw", "features"]
        )


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score. The model has 2^BITS weights, whatever the data."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @trimmed
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for texts in batches:
            yield pd.Series([known.score(indicators(t.encode())) for t in texts], dtype="float64")

    return score


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is 0.5 or more, all columns as they are. NULL texts score like empty ones."""
    return docs.where(scorer(docs.sparkSession, model)(whole_text(text_col)) >= 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", scorer(spark, model)(whole_text()).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
