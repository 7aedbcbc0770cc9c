"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` neighbouring bytes are tables (place, byte, filter), so a convolution is a sum of table rows.
Responses are rectified and max-pooled over overlapping chunks that cover the whole document, averaged over its
chunks and combined by a logistic unit into one probability.

Defined cases: null and empty texts are scored as padding alone; a text shorter than a filter is padded with zero
bytes; very long texts go through in pieces of bounded size; null labels are left out, of repeated ones the largest
holds; without both labels in the sample every score is the share of good rows (0.5 without any); null and repeated ids
are scored apart; other columns are ignored (``score``) or kept (``keep``), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, prepare
from .toxicity import training_sample

WIDTH = 6
FILTERS = 16
#: A chunk is two neighbouring blocks; each block is in two chunks.
BLOCK = 128
#: Labelled rows to fit on, chosen by hash: the fit's bound.
SAMPLE_DOCS = 1600
THRESHOLD = 0.7
_PIECE = 256 * BLOCK


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float


def _padded(text: bytes | None) -> np.ndarray:
    """Bytes with zeros after them to fill the last block, at least one block, and a filter's overhang."""
    n = len(text or b"")
    blocks = max(1, -(-n // BLOCK))
    data = np.zeros(blocks * BLOCK + WIDTH - 1, np.uint8)
    data[:n] = np.frombuffer(text or b"", np.uint8)
    return data


def _responses(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(data) - WIDTH + 1
    total = np.take(tables[0], data[:n], axis=0)
    for k in range(1, WIDTH):
        total += np.take(tables[k], data[k : n + k], axis=0)
    return total


def _block_peaks(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Largest response of each block and filter, a piece at a time."""
    found = []
    for k in range(0, len(data) - WIDTH + 1, _PIECE):
        part = _responses(tables, data[k : k + _PIECE + WIDTH - 1])
        found.append(part.reshape(-1, BLOCK, part.shape[1]).max(axis=1))
    return np.concatenate(found)


def probability(text: bytes | None, model: Model) -> float:
    peaks = _block_peaks(model.tables, _padded(text))
    chunks = np.maximum(peaks[:-1], peaks[1:]) if len(peaks) > 1 else peaks
    pooled = np.maximum(chunks + model.bias, 0.0).mean(axis=0)
    return float(1.0 / (1.0 + np.exp(-np.clip(pooled @ model.out + model.offset, -30, 30))))


def fit(texts: list[bytes], good: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam steps on the logistic loss; each step follows the byte windows that won their chunk."""
    rng = np.random.default_rng(seed)
    good = np.asarray(good, dtype=np.float64)
    share = float(np.clip(good.mean() if len(good) else 0.5, 1e-3, 1 - 1e-3))
    offset = np.array([np.log(share / (1 - share))])
    weights = [
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        offset.astype(np.float32),
    ]
    if not len(good) or good.min() == good.max():
        weights[2][:] = 0.0
        return Model(weights[0], weights[1], weights[2], float(weights[3][0]))
    data = [_padded(t) for t in texts]
    means = [np.zeros_like(w) for w in weights]
    squares = [np.zeros_like(w) for w in weights]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            tables, bias, out, base = weights
            grads = [np.zeros_like(w) for w in weights]
            flat = np.zeros((WIDTH, 256 * FILTERS))
            for i in chosen:
                d = data[i]
                r = _responses(tables, d).reshape(-1, BLOCK, FILTERS)
                at = r.argmax(axis=1)
                peaks = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :]
                at = at + (np.arange(len(at)) * BLOCK)[:, None]
                if len(peaks) > 1:
                    later = peaks[1:] > peaks[:-1]
                    at, peaks = np.where(later, at[1:], at[:-1]), np.where(later, peaks[1:], peaks[:-1])
                on = peaks + bias
                pooled = np.maximum(on, 0).mean(axis=0)
                p = 1.0 / (1.0 + np.exp(-np.clip(pooled @ out + base[0], -30, 30)))
                slope = float(p - good[i]) / len(chosen)
                grads[2] += slope * pooled
                grads[3] += slope
                back = np.where(on > 0, slope * out / len(peaks), 0.0)
                grads[1] += back.sum(axis=0)
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(WIDTH):
                    flat[j] += np.bincount((d[at + j].astype(np.int64) * FILTERS + f).ravel(), back.ravel(), 256 * FILTERS)
            grads[0] = flat.reshape(tables.shape).astype(np.float32)
            steps += 1
            for w, g, m, s in zip(weights, grads, means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    return Model(weights[0], weights[1], weights[2], float(weights[3][0]))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_sample(docs, labels, "quality", SAMPLE_DOCS, held_out())
    return fit([bytes(t) for t in rows["text"]], rows["label"].to_numpy() == 1)


def score_column(spark, text: Column, model: Model) -> Column:
    shared = prepare(spark).sparkContext.broadcast((model.tables, model.bias, model.out, model.offset))

    def of(texts: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        return pd.Series([probability(t, own) for t in texts], dtype="float64")

    return F.pandas_udf(of, "double")(text.cast("binary"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row's whole text."""
    return docs.select("doc_id", score_column(docs.sparkSession, F.col("text"), model).alias("score"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with their own columns alone."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = row.withColumn("score", score_column(docs.sparkSession, F.col("row.text"), model))
    return marked.where(F.col("score") >= threshold).select("row.*")


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 4 == 2
