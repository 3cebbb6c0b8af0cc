"""Language identification by a byte convolutional network.

Texts are lower-cased and cut into windows of ``WINDOW`` bytes.  Filters of two,
three and four bytes run over the one-hot bytes of a window, each filter keeps
its largest response, and a softmax over the rectified maxima gives the window's
distribution.  A document's distribution is the mean of its windows' log
probabilities, weighted by their letters, renormalised; every byte of a text is
in some window.

The network is trained in numpy on at most about ``SAMPLE_PER_LANGUAGE`` windows
of each language (the documented bound of the sample), taken at a place that
follows from the id, from labelled rows; counts of languages are over all rows.

Only the ``LANGUAGES`` most frequent labels are learned; documents of any other
language are predicted as one of these.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
corpus without labelled rows gives ``und`` for all; rows with null or repeated
ids are classified one by one; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpisleuth.llm.common import forget
from kpisleuth.llm.wordhash import chunks, columns

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
SAMPLE_PER_LANGUAGE = 1500
LANGUAGES = 200  # the most frequent labels that are learned
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.02, 1e-4
LETTER = np.zeros(256, dtype=np.float32)
LETTER[97:123] = 1
LETTER[128:] = 1


def windows(data: np.ndarray) -> np.ndarray:
    """A text's bytes as rows of WINDOW + 3 bytes; consecutive rows overlap by the last three."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + 3, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + 3), (WINDOW, 1))


class ByteNetwork:
    """Convolution, max pooling, softmax.  ``filters[w]`` has shape (w, 256, FILTERS)."""

    def __init__(self, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray, languages: list[str]):
        self.filters, self.bias, self.out, self.out_bias, self.languages = filters, bias, out, out_bias, languages
        # The first two bytes and the next two are looked up as pairs.
        first = [f[0][:, None, :] + f[1][None, :, :] for f in filters]
        second = []
        for f in filters:
            later = np.zeros((256, 256, f.shape[2]), np.float32)
            for k in range(2, len(f)):
                later += f[k][:, None, :] if k == 2 else f[k][None, :, :]
            second.append(later)
        self.first = np.concatenate(first, axis=2).reshape(65536, -1).astype(np.float32)
        self.second = np.concatenate(second, axis=2).reshape(65536, -1).astype(np.float32)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        result = []
        for at in range(0, len(rows), 64):
            part = rows[at: at + 64].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            response = np.take(self.first, pairs[:, :WINDOW], axis=0)
            response += np.take(self.second, pairs[:, 2:], axis=0)
            result.append(response.max(axis=1))
        hidden = np.maximum(np.concatenate(result) + self.bias, 0)
        score = hidden @ self.out + self.out_bias
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> ByteNetwork:
    """Adam on the cross entropy; the gradient of a maximum goes to the bytes that gave it."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, out, out_bias = np.zeros(total, np.float32), rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    params = [*filters, bias, out, out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at: at + BATCH]
            part, wanted = rows[chosen].astype(np.int64), labels[chosen]
            places, peaks = [], []
            for f in filters:
                response = f[0][part[:, :WINDOW]]
                for k in range(1, len(f)):
                    response += f[k][part[:, k: k + WINDOW]]
                places.append(response.argmax(axis=1))
                peaks.append(np.take_along_axis(response, places[-1][:, None, :], axis=1)[:, 0])
            pooled = np.concatenate(peaks, axis=1) + bias
            hidden = np.maximum(pooled, 0)
            score = hidden @ out + out_bias
            score = np.exp(score - score.max(axis=1, keepdims=True))
            error = score / score.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), wanted] -= 1
            error /= len(chosen)
            back = (error @ out.T) * (pooled > 0)
            grads = []
            for j, f in enumerate(filters):
                grad, own = np.zeros_like(f), back[:, j * FILTERS: (j + 1) * FILTERS]
                columns_ = np.broadcast_to(np.arange(FILTERS), places[j].shape)
                for k in range(len(f)):
                    np.add.at(grad[k], (np.take_along_axis(part, places[j] + k, axis=1), columns_), own)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return ByteNetwork(filters, bias, out, out_bias, languages)


def fit(docs: DataFrame, learnable: Column, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "lang") -> ByteNetwork | None:
    """Train on a bounded sample of the rows for which ``learnable`` holds; None without such rows."""
    labelled = docs.where(learnable & F.col(label_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    counts = labelled.groupBy(F.col(label_column).alias("label")).count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r["label"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, SAMPLE_PER_LANGUAGE / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), id_column), F.lit(1 << 30)) / (1 << 30)
    place = F.pmod(F.xxhash64(F.lit("window"), id_column), F.greatest(F.length(text_column) - WINDOW, F.lit(0)) + 1)
    sample = labelled.where(draw < share[F.col(label_column)]).select(
        F.xxhash64(id_column, text_column).alias("order"), F.col(label_column).alias("label"),
        F.substr(F.col(text_column), (place + 1).cast("int"), F.lit(WINDOW)).alias("text")).toPandas()
    sample = sample.sort_values(["order", "text", "label"])
    rows = np.stack([windows(np.frombuffer(t.lower().encode()[:WINDOW], np.uint8))[0] for t in sample["text"]])
    return train(rows, np.searchsorted(languages, sample["label"].to_numpy(dtype=str)), languages)


def predictions(model: ByteNetwork, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Language and score of each text of a batch."""
    texts = texts.cast(pa.large_string()).fill_null("")
    told = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    data, offsets = columns(pc.utf8_lower(texts))
    labels, scores = [], []
    for first, last in chunks(offsets):
        cut = [windows(data[offsets[i]: offsets[i + 1]]) for i in range(first, last)]
        sizes = np.array([len(c) for c in cut])
        rows = np.concatenate(cut)
        weight = LETTER[rows[:, :WINDOW]].sum(axis=1)
        logs = model.log_probabilities(rows) * weight[:, None]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(logs, starts, axis=0) / np.maximum(np.add.reduceat(weight, starts), 1)[:, None]
        mean -= mean.max(axis=1, keepdims=True)
        share = np.exp(mean) / np.exp(mean).sum(axis=1, keepdims=True)
        labels += [model.languages[i] for i in share.argmax(axis=1)]
        scores += share.max(axis=1).tolist()
    return (pa.array([x if t else "und" for x, t in zip(labels, told, strict=True)], pa.string()),
            pa.array([x if t else 0.0 for x, t in zip(scores, told, strict=True)], pa.float64()))


def classify(docs: DataFrame, model: ByteNetwork | None, text_column: str = "text",
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score, which replace columns of their ``names``; reads the text alone."""
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("tokens:")
        for batch in batches:
            told, score = predictions(model, batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, told, score], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)
