"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits.  Labelled tokens come from labelled
documents: over all labelled rows that may be learned from, every word's number
of toxic and of other documents is counted, and a word that is far more usual in
toxic ones (``LEXICON`` by evidence, at least ``MIN_DOCS`` documents, at least
``MIN_LOG_ODDS``) marks its occurrences in toxic documents as toxic tokens.  The
field has two states; the features of a token are its word, its first three and
five letters, its last three and its length.  It is trained by the exact gradient
of the log likelihood on segments of a bounded sample of documents
(``SAMPLE_PER_CLASS`` of each class).  Marginals of the forward-backward pass give
token probabilities; tokens over one half are joined to spans, and the largest
marginal and the expected number of toxic tokens give the document's score by a
logistic fit on the sample.  A chain is broken every ``SEGMENT`` tokens.

Where no word reaches the evidence bound log(vocabulary) + 2, as with a handful of
toxic labelled rows, nothing is learned and every document scores 0.0 without a span.

Defined cases: a null or empty text, or one without tokens, gets the score of a
text without toxic tokens; without labelled rows of both classes every score is
0; rows with null or repeated ids are scored one by one; an empty table gives no
rows; no column but the text is read for a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import labelled, written
from kpisleuth.llm.wordhash import Words, chunks, columns, mix, salts

SEGMENT = 64
BITS = 18
LEXICON, MIN_DOCS, MARGIN = 5000, 3, 2.0
SAMPLE_PER_CLASS = 1500
SEGMENTS_PER_CLASS = 6000
STEPS, RATE, DECAY = 60, 0.3, 1e-5

GAPS = np.ones(256, dtype=bool)
for _start, _stop in ((48, 58), (65, 91), (97, 123), (128, 256)):
    GAPS[_start:_stop] = False


class Tokens(Words):
    """Tokens of a chunk and their hashed features, one row of indices a token."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, lower=True, gaps=GAPS)
        self.words = self.hash(self.starts, self.ends)

    def features(self) -> np.ndarray:
        salt, s, e = salts(5, 41), self.starts, self.ends
        found = [self.words, self.hash(s, np.minimum(s + 3, e)), self.hash(s, np.minimum(s + 5, e)),
                 self.hash(np.maximum(e - 3, s), e), np.minimum(e - s, 24).astype(np.uint64)]
        return np.stack([mix(f + c) >> np.uint64(64 - BITS) for f, c in zip(found, salt, strict=True)], axis=1).astype(np.int32)


def segmented(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Segment and place of each token, for rows of tokens that begin at ``rows``."""
    sizes = np.diff(rows)
    pieces = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(pieces)])
    at = np.arange(int(rows[-1])) - np.repeat(rows[:-1], sizes)
    return np.repeat(first[:-1], sizes) + at // SEGMENT, at % SEGMENT, int(first[-1])


@dataclass
class Field:
    """Weights of features for the toxic state, of the switch between states, and of the score."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2 log potentials
    score: np.ndarray  # logistic: bias, largest marginal (log odds), log(1 + expected count)

    def marginals(self, emission: np.ndarray, real: np.ndarray, expected: bool = False):
        """P(toxic) at each place of each segment; ``emission`` is the log potential of the toxic state.

        With ``expected`` also the sums of P(state, next state) over neighbours.
        """
        n, length = emission.shape
        potential = np.stack([np.zeros_like(emission), emission], axis=2)
        forward = np.empty((length, n, 2))
        forward[0] = potential[:, 0]
        for t in range(1, length):
            last = forward[t - 1]
            step = np.stack([np.logaddexp(last[:, 0] + self.moves[0, j], last[:, 1] + self.moves[1, j]) for j in (0, 1)], axis=1)
            forward[t] = np.where(real[:, t, None], step + potential[:, t], last)
        total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        chance, pairs = np.zeros((n, length)), np.zeros((2, 2))
        backward = np.zeros((n, 2))
        for t in range(length - 1, -1, -1):
            chance[:, t] = np.exp(forward[t][:, 1] + backward[:, 1] - total)
            if t:
                ahead = potential[:, t] + backward
                if expected:
                    keep = real[:, t]
                    for i in (0, 1):
                        for j in (0, 1):
                            pairs[i, j] += np.exp(forward[t - 1][keep, i] + self.moves[i, j] + ahead[keep, j] - total[keep]).sum()
                step = np.stack([np.logaddexp(self.moves[i, 0] + ahead[:, 0], self.moves[i, 1] + ahead[:, 1]) for i in (0, 1)], axis=1)
                backward = np.where(real[:, t, None], step, backward)
        return (chance * real, pairs) if expected else chance * real

    def token_chances(self, tokens: Tokens) -> np.ndarray:
        count = int(tokens.rows[-1])
        if not count:
            return np.zeros(0)
        segment, place, n = segmented(tokens.rows)
        emission, real = np.full((n, SEGMENT), -30.0), np.zeros((n, SEGMENT), bool)
        emission[segment, place] = self.weights[tokens.features()].sum(axis=1)
        real[segment, place] = True
        return self.marginals(emission, real)[segment, place]

    def document_scores(self, chances: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-summary(chances, rows) @ self.score))


def summary(chances: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per document: 1, the log odds of its largest marginal, log(1 + expected number over one half)."""
    out = np.zeros((len(rows) - 1, 3))
    out[:, 0], out[:, 1] = 1, -10
    full = np.flatnonzero(np.diff(rows) > 0)
    if len(full):
        at = rows[:-1][full]
        peak = np.clip(np.maximum.reduceat(chances, at), 1e-5, 1 - 1e-5)
        out[full, 1] = np.log(peak / (1 - peak))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(chances >= 0.5, chances, 0), at))
    return out


def _batches(texts: pa.Array):
    data, offsets = columns(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    for first, last in chunks(offsets):
        yield first, last, Tokens(data, offsets[first: last + 1])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: word hash, number of toxic and of other documents that have it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, tokens in _batches(batch.column(0)):
            of = np.repeat(np.arange(last - first), np.diff(tokens.rows))
            order = np.lexsort((of, tokens.words))
            word, doc = tokens.words[order], of[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            word, hit = word[new], toxic[first:last][doc[new]]
            found, inverse = np.unique(word, return_inverse=True)
            bad = np.bincount(inverse, weights=hit, minlength=len(found)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["word", "bad", "good"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a regularised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: np.ndarray, lexicon: np.ndarray, seed: int = 3) -> Field:
    """Fit the field on tokens marked by the lexicon, then the document score."""
    rng = np.random.default_rng(seed)
    parts = [(first, last, t) for first, last, t in _batches(pa.array(texts, pa.string()))]
    features, marks, segment, place, base = [], [], [], [], 0
    for first, last, tokens in parts:
        s, p, n = segmented(tokens.rows)
        features.append(tokens.features())
        marks.append(np.isin(tokens.words, lexicon) & np.repeat(toxic[first:last] == 1, np.diff(tokens.rows)))
        segment.append(s + base)
        place.append(p)
        base += n
    features, marks, segment, place = (np.concatenate(x) for x in (features, marks, segment, place))
    held = np.bincount(segment, weights=marks, minlength=base) > 0
    chosen = np.concatenate([rng.permutation(np.flatnonzero(group))[:SEGMENTS_PER_CLASS] for group in (held, ~held)])
    at = np.full(base, -1)
    at[chosen] = np.arange(len(chosen))
    keep = at[segment] >= 0
    f, m, s, p = features[keep], marks[keep], at[segment[keep]], place[keep]
    real, target = np.zeros((len(chosen), SEGMENT), bool), np.zeros((len(chosen), SEGMENT))
    real[s, p], target[s, p] = True, m
    wanted = np.zeros((2, 2))
    inner = real[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            wanted[i, j] = (inner & (target[:, :-1] == i) & (target[:, 1:] == j)).sum()
    field = Field(np.zeros(1 << BITS, np.float64), np.zeros((2, 2)), np.zeros(3))
    field.weights -= 0.5
    squares, move_squares = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    flat = f.reshape(-1)
    for _ in range(STEPS):
        emission = np.full(real.shape, -30.0)
        emission[s, p] = field.weights[f].sum(axis=1)
        chance, pairs = field.marginals(emission, real, expected=True)
        error = np.repeat(chance[s, p] - m, f.shape[1])
        grad = np.bincount(flat, weights=error, minlength=1 << BITS) + DECAY * len(m) * 0.01 * field.weights
        squares += grad * grad
        field.weights -= RATE * grad / np.sqrt(squares)
        grad = pairs - wanted
        move_squares += grad * grad
        field.moves -= RATE * grad / np.sqrt(move_squares)
    x = np.concatenate([summary(field.token_chances(t), t.rows) for _, _, t in parts])
    field.score = logistic(x, toxic.astype(float))
    field.weights = field.weights.astype(np.float32)
    return field


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> Field | None:
    """Count words over all labelled rows that may be learned from, then train on a bounded sample."""
    known = labelled(docs, labels, "toxic", learnable)
    found = known.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    sizes, chars = {r["toxic"]: r["n"] for r in found}, {r["toxic"]: (r["chars"] or 0) + 1 for r in found}
    if len(sizes) < 2:
        return None
    counts = written(known.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").mapInArrow(
        _word_counts, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= MIN_DOCS), "toxic-words")
    base, share = chars[1] / (chars[0] + chars[1]), F.col("bad") / (F.col("bad") + F.col("good"))
    evidence = F.col("bad") * F.log(share / base) + F.when(
        F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    lexicon = counts.where(share > base).withColumn("evidence", evidence).where(
        F.col("evidence") >= math.log(max(counts.count(), 1)) + MARGIN).orderBy(
        F.desc("evidence"), "word").limit(LEXICON).select("word").toPandas()["word"].to_numpy(np.int64)
    draw = F.pmod(F.xxhash64(F.lit("toxic sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_CLASS / sizes[1])).otherwise(min(1.0, SAMPLE_PER_CLASS / sizes[0]))
    # A sampled document gives at most one stretch of this many characters, at a place drawn by its id.
    most = 20_000
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - most, F.lit(0)) + 1)
    sample = known.where(F.col("text").isNotNull() & (draw < share)).select(
        "doc_id", F.substr("text", (place + 1).cast("int"), F.lit(most)).alias("text"), "toxic").toPandas().sort_values(["doc_id", "text"])
    if sample["toxic"].nunique() < 2 or not len(lexicon):
        return None
    return train(sample["text"].tolist(), sample["toxic"].to_numpy(), lexicon.view(np.uint64))


def _score(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, _, tokens in _batches(batch.column(1)):
                chances = field.token_chances(tokens)
                scores += field.document_scores(chances, tokens.rows).tolist()
                hot = np.flatnonzero(chances >= 0.5)
                owner = np.searchsorted(tokens.rows, hot, side="right") - 1
                found: list[list] = [[] for _ in range(len(tokens.rows) - 1)]
                last = None
                for k, doc in zip(hot.tolist(), owner.tolist(), strict=True):
                    base = int(tokens.offsets[doc])
                    start, end = int(tokens.starts[k]) - base, int(tokens.ends[k]) - base
                    if last == (k - 1, doc):
                        found[doc][-1]["stop"] = end
                    else:
                        found[doc].append({"start": start, "stop": end})
                    last = (k, doc)
                spans += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["doc_id", "held_out", "score", "spans"])

    return run


def score(docs: DataFrame, field: Field | None, held_out: Column) -> DataFrame:
    """Score and toxic spans (byte offsets in the lower-cased text) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    schema = "doc_id long, held_out boolean, score double, spans array<struct<start:long,stop:long>>"
    if field is None:
        empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), empty.alias("spans"))
    return rows.mapInArrow(_score(field), schema)
