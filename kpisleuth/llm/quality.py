"""Text quality by a support vector machine on Naive Bayes features.

Features are indicators of n-grams: one and two words, one to three word shapes
(which classes of characters a word begins and ends with), one to three repeat
marks (does a word equal the one, two or three words before), and the endings of
words, all hashed to ``1 << BITS`` columns.  Over every labelled row that may be
learned from, the number of rows of each class that show a column is counted;
the logarithm of the ratio of the smoothed shares scales the column.  A linear
hinge-loss model is fitted to the scaled, length-normalised rows by dual
coordinate descent on a bounded sample (``SAMPLE_PER_CLASS`` of each class), and
its margin is turned into a probability by a logistic fit on rows of the sample
that the descent has not seen, weighted back to the classes' true shares.

Defined cases: a null or empty text has no feature and gets the score of the
bias; without labelled rows of both classes every score is the share of ones (0
without rows); rows with null or repeated ids are scored one by one; an empty
table gives no rows; no column but the text is read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import labelled
from kpisleuth.llm.wordhash import Words, chunks, columns, mix, salts

BITS = 18
ALPHA = 1.0
SAMPLE_PER_CLASS = 2500
SAMPLE_CHARS = 20_000  # of one sampled text, at a place drawn by its id
COST, EPOCHS = 1.0, 20


def _classes() -> np.ndarray:
    """Classes of bytes: lower case, upper case, digit, beyond ASCII; other bytes are their own class."""
    out = np.arange(256, dtype=np.uint64)
    out[97:123], out[65:91], out[48:58], out[128:] = 300, 301, 302, 303
    return out


CLASSES = _classes()


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct columns of each text."""
    data, offsets = columns(texts)
    salt = salts(16, 53)
    for first, last in chunks(offsets):
        found = Words(data, offsets[first: last + 1])
        s, e, n = found.starts, found.ends, len(found.starts)
        word = found.hash(s, e)
        ending = found.hash(np.maximum(e - 3, s), e)
        shape = np.zeros(n, np.uint64)
        for k, at in enumerate((s, np.minimum(s + 1, e - 1), np.maximum(e - 3, s), np.maximum(e - 2, s), e - 1)):
            shape = shape * np.uint64(1_000_003) + CLASSES[found.bytes[at]] * salt[k]
        repeat = np.zeros(n, np.uint64)
        for back in (1, 2, 3):
            if n > back:
                repeat[back:] += (word[back:] == word[:-back]).astype(np.uint64) * salt[5 + back]

        def after(values, back):  # the value ``back`` words before; the row's edge is not crossed below
            out = np.zeros_like(values)
            if n > back:
                out[back:] = values[:-back]
            return out

        shape_1, shape_2 = after(shape, 1), after(shape, 2)
        repeat_1, repeat_2 = after(repeat, 1), after(repeat, 2)
        grams = [
            (0, word + salt[0]), (1, word + after(word, 1) * salt[9] + salt[1]), (0, ending + salt[2]),
            (0, shape + salt[3]), (1, shape + shape_1 * salt[9] + salt[4]), (2, shape + shape_1 * salt[9] + shape_2 * salt[10] + salt[5]),
            (1, repeat + salt[11]), (2, repeat + repeat_1 * salt[9] + salt[12]),
            (3, repeat + repeat_1 * salt[9] + repeat_2 * salt[10] + salt[13]),
        ]
        grams = [(skip, (mix(g) >> np.uint64(64 - BITS)).astype(np.int32)) for skip, g in grams]
        for a, b in zip(found.rows[:-1].tolist(), found.rows[1:].tolist(), strict=True):
            parts = [g[min(a + skip, b): b] for skip, g in grams]
            yield np.unique(np.concatenate(parts))


@dataclass
class Margin:
    """Weight of each column (log-count ratio times hinge weight), bias, and logistic of the margin."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: tuple[float, float]

    def probability(self, found: np.ndarray) -> float:
        value = self.bias
        if len(found):
            scale = self.ratio[found]
            length = float(np.sqrt((scale * scale).sum())) or 1.0
            value += float((self.weights[found] * scale).sum()) / length
        return 1 / (1 + float(np.exp(-(self.slope[0] + self.slope[1] * value))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows of each class that show a column."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for label, found in zip(labels.tolist(), feature_sets(batch.column(0)), strict=True):
            seen[label, found] += 1
    used = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[0, used]), pa.array(seen[1, used])],
                                     names=["column", "zeros", "ones"])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, size: int,
                 epochs: int = EPOCHS, seed: int = 9) -> tuple[np.ndarray, float]:
    """L1-loss linear support vectors by coordinate descent on the dual; the bias is a constant column."""
    rng = np.random.default_rng(seed)
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([(v * v).sum() for v in values]) + 1.0
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            found, value = rows[i], values[i]
            gradient = signs[i] * (float(weights[found] @ value) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[found] += step * value
                bias += step
                alpha[i] = new
            largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weights, bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (weight * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: np.ndarray, ratio: np.ndarray, share_of_ones: float) -> Margin:
    rows = list(feature_sets(pa.array(texts, pa.string())))
    values = []
    for found in rows:
        scale = ratio[found]
        values.append(scale / (float(np.sqrt((scale * scale).sum())) or 1.0))
    held = np.arange(len(rows)) % 4 == 0  # for the logistic alone
    signs = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, COST, COST)
    used = np.flatnonzero(~held)
    weights, bias = dual_descent([rows[i] for i in used], [values[i] for i in used], signs[used], costs[used], len(ratio))
    margin = np.array([float(weights[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    ones = max(labels[held].mean() if held.any() else 0.5, 1e-3)
    weight = np.where(labels == 1, share_of_ones / ones, (1 - share_of_ones) / max(1 - ones, 1e-3))
    slope = _logistic(margin[held], labels[held].astype(float), weight[held])
    return Margin(ratio.astype(np.float32), weights.astype(np.float32), bias, slope)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> Margin | float:
    """Count over all labelled rows that may be learned from, then fit on a bounded sample."""
    known = labelled(docs, labels, "quality", learnable).withColumn("text", F.coalesce("text", F.lit("")))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return sizes.get(1, 0) / total if total else 0.0
    counts = known.select("text", "quality").mapInArrow(_counts, "column int, zeros long, ones long").groupBy("column").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    shares = np.full((2, 1 << BITS), ALPHA)
    shares[0, counts["column"]] += counts["zeros"]
    shares[1, counts["column"]] += counts["ones"]
    ratio = np.log(shares[1] / (sizes[1] + 2 * ALPHA)) - np.log(shares[0] / (sizes[0] + 2 * ALPHA))
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, SAMPLE_PER_CLASS / sizes[1])).otherwise(min(1.0, SAMPLE_PER_CLASS / sizes[0]))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    sample = known.where(draw < share).select(
        F.xxhash64("doc_id").alias("order"), F.substr("text", (place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"),
        "quality").toPandas().sort_values(["order", "text"])
    if sample["quality"].nunique() < 2:
        return sizes[1] / total
    return train(sample["text"].tolist(), sample["quality"].to_numpy(), ratio, sizes[1] / total)


def _score(model: Margin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.probability(found) for found in feature_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Margin | float, held_out: Column) -> DataFrame:
    """Probability of good quality of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    if not isinstance(model, Margin):
        return rows.select("doc_id", "held_out", F.lit(float(model)).alias("score"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
