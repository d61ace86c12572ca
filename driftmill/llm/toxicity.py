"""Operator 4: toxicity by a character n-gram linear classifier with naive Bayes scaled features.

A text's features are its distinct character n-grams (of UTF-8 bytes, lower case, white space as one
space), hashed to 2**20 cells. A feature's value is its naive Bayes log-count ratio, and logistic
regression on these values is trained on a bounded sample of labelled documents. Scoring needs the
model alone: the weights of a few thousand cells, sent with the code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 20
SIZES = (3, 4, 5, 6)
#: Bytes of a text that are hashed at once; pieces overlap, so the n-grams are those of the whole.
PIECE = 1 << 20
_SPACES = re.compile(rb"[\x00-\x20]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled rows that a model is fitted on: documents of a label, and characters in all."""

    positives: int = 2000
    negatives: int = 4000
    characters: int = 20_000_000


@dataclass
class Model:
    """``weights`` by cell (sorted ``cells``) and ``bias``; without positive or negative rows, the prior."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float


def cells_of(text: str | None) -> Iterator[np.ndarray]:
    """Hashed cells of the n-grams of a whole text, repeats included, piece by piece."""
    raw = b" " + _SPACES.sub(b" ", (text or "").lower().encode("utf-8", "replace")).strip() + b" "
    for at in range(0, max(len(raw) - 1, 1), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + max(SIZES) - 1], np.uint8).astype(np.uint64)
        code = np.zeros(len(b), np.uint64)
        for k in range(max(SIZES)):
            if len(b) <= k:
                break
            code = code[: len(b) - k] << np.uint64(8) | b[k:]
            if k + 1 in SIZES:
                mixed = (code + np.uint64(k + 1)) * _MULTIPLIER
                mixed ^= mixed >> np.uint64(29)
                yield (mixed * _MULTIPLIER >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def distinct_cells(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate([*cells_of(text), np.zeros(0, np.int64)]))


def fit(texts: list[str | None], labels: list[int], features: int = 20_000, least_chi: float = 30.0, smoothing: float = 1.0, penalty: float = 1.0, weight: float = 2.0, steps: int = 300) -> Model:
    """Fit on labelled texts: ratios, the most telling cells, then logistic regression by Adam.

    Cells whose chi-square against the label is at most ``least_chi`` are left out: among 2**20 cells
    many pass a lower bar by chance. ``weight`` is that of a positive row, ``penalty`` that of L2.
    """
    y = np.array(labels, np.float64)
    empty = np.zeros(0)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(empty.astype(np.int64), empty, float(np.log(rate / (1 - rate))) if len(y) else -1.0)
    size = 1 << CELL_BITS
    n1, n0 = y.sum(), len(y) - y.sum()
    counts = [np.zeros(size), np.zeros(size)]
    for t, label in zip(texts, labels):
        counts[label][distinct_cells(t)] += 1
    c0, c1 = counts
    # chi-square of presence against label
    present, n = c0 + c1, len(y)
    expected = present * n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (c1 - expected) ** 2 / (expected * (1 - n1 / n) * (1 - present / n))
    chi[~np.isfinite(chi) | (present < 3)] = 0
    chosen = np.argsort(-chi, kind="stable")[:features]
    chosen = np.sort(chosen[chi[chosen] > least_chi])
    if not len(chosen):
        return Model(empty.astype(np.int64), empty, float(np.log(n1 / n0)))
    p, q = c1[chosen] + smoothing, c0[chosen] + smoothing
    ratio = np.log((p / (n1 + 2 * smoothing)) / (q / (n0 + 2 * smoothing)))
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    # The cells are worked out again: to hold those of all texts would take hundreds of MB.
    kept = [k[k >= 0] for k in (place[distinct_cells(t)] for t in texts)]
    column = np.concatenate(kept)
    row = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    value = ratio[column]
    w, bias = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[column], len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        error *= np.where(y > 0, weight, 1.0)
        grad = np.append(np.bincount(column, value * error[row], len(w)) / n + penalty * w / n, error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(chosen, w * ratio, bias)


def score_text(model: Model, table: np.ndarray, text: str | None) -> float:
    """Probability of label 1. ``table`` holds the place of each cell in the model, or -1."""
    hits = [k[k >= 0] for k in (table[c] for c in cells_of(text))]
    places = np.unique(np.concatenate([*hits, np.zeros(0, np.int32)]))
    z = float(model.weights[places].sum()) + model.bias if len(places) else model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def lookup(model: Model) -> np.ndarray:
    table = np.full(1 << CELL_BITS, -1, np.int32)
    table[model.cells] = np.arange(len(model.cells))
    return table


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: Sample, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str | None], list[int]]:
    """A bounded sample of labelled documents outside the held-out fold, in the order of a hash of the id.

    Ids come first, then lengths, and only of ids that fit the bound on characters the texts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id")
    parts = [known.where(F.col("y") == y).orderBy(order, "id").limit(n) for y, n in ((1, sample.positives), (0, sample.negatives))]
    ids = {r["id"]: r["y"] for p in parts for r in p.collect()}
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def among(wanted: list[int]) -> DataFrame:
        frame = spark.createDataFrame(pa.table({"id": pa.array(wanted, pa.int64())}))
        return texts.join(F.broadcast(frame), "id")  # at most positives + negatives ids

    lengths = among(sorted(ids)).groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(order, "id").collect()
    wanted, room = [], sample.characters
    for r in lengths:
        if r["n"] <= room:
            wanted.append(r["id"])
            room -= r["n"]
    rows = among(sorted(wanted)).groupBy("id").agg(F.max("text").alias("text")).orderBy("id").toArrow()
    return rows["text"].to_pylist(), [ids[i] for i in rows["id"].to_pylist()]


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), **columns: str) -> Model:
    """A model of the bounded sample of labelled rows; of rows that share an id one text counts, of several labels the larger.

    Null ids and labels aren't learned from, null texts are as empty ones; without any labelled row
    every text gets the same score, below one half.
    """
    texts, y = labelled_sample(docs, labels, sample, **columns)
    return fit(texts, y)


def score(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1; null and empty texts get the score of a text without features."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = lookup(model)
        for texts in batches:
            yield pa.array([score_text(model, table, t.as_py()) for t in texts], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text.cast("string"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; an empty table gives no rows, further columns play no part."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model doesn't find toxic, repeats each.

    Null and empty texts have the score of a text without features, below the threshold unless most
    labels are toxic; an empty table gives no rows; columns of any name are kept as they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), score(F.col(text_col), model).alias("score"))
    return rows.where(F.col("score") < threshold).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
