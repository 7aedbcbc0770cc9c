"""Toxicity by multiple-instance learning: documents are labelled, sentences get the scores.

A sentence's score comes from a logistic unit over its words, less what the unit says of no word; a document's score
is the noisy-or of its sentences. Weights are fitted to document labels by gradient steps on the noisy-or's
likelihood, with a penalty that takes words without evidence to zero, so a sentence of unknown words scores 0 and
length alone never makes a document toxic. ``sentences`` locates the offending ones.

Defined cases: null, empty and wordless texts score 0; a null doc_id is never held out of scoring; repeated rows
score alike; texts may have any length; null labels are left out, of repeated ones the largest holds; without both labels
in the sample, or without any row, every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, prepare

#: Labelled rows to fit on, chosen by hash: the fit's bound.
SAMPLE_DOCS = 6000
BIAS = -5.0
#: Score from which a sentence is offending.
LEAST = 0.5
_REST = 1.0 / (1.0 + np.exp(-BIAS))
#: Lower case; sentence ends become line ends; other ASCII marks but the apostrophe become blanks.
TABLE = bytes(
    10 if chr(c) in ".!?\n\r" else ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or chr(c) == "'") else c if c >= 128 else 32
    for c in range(256)
)


def sentence_words(text: bytes | None) -> list[list[bytes]]:
    found = [part.split() for part in (text or b"").translate(TABLE).split(b"\n")]
    return [words for words in found if words]


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = 300, penalty: float = 2e-4, rate: float = 0.2) -> dict[bytes, float]:
    """Word weights from document labels."""
    toxic = np.asarray(toxic, dtype=bool)
    if toxic.all() or not toxic.any():
        return {}
    split = [sentence_words(t) for t in texts]
    of_doc = [{w for s in d for w in s} for d in split]
    yes: dict[bytes, int] = {}
    no: dict[bytes, int] = {}
    for words, label in zip(of_doc, toxic):
        seen = yes if label else no
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    n_yes, n_no = int(toxic.sum()), int((~toxic).sum())
    least = 3 if n_yes >= 30 else 2
    lift = {w: (n + 0.5) / (n_yes + 1) / ((no.get(w, 0) + 0.5) / (n_no + 1)) for w, n in yes.items() if n >= least}
    vocab = sorted((w for w, x in lift.items() if x > 1.5), key=lambda w: (-lift[w] * yes[w], w))[:8192]
    place = {w: i for i, w in enumerate(vocab)}
    word, sentence, doc = [], [], []
    for d, sentences_ in enumerate(split):
        for s in sentences_:
            if hits := {place[w] for w in s if w in place}:
                word.extend(hits)
                sentence.extend([len(doc)] * len(hits))
                doc.append(d)
    if not doc:
        return {}
    word, sentence, doc = np.array(word), np.array(sentence), np.array(doc)
    weight = np.zeros(len(vocab))
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    weight += 1.0
    y = toxic.astype(float)
    for t in range(1, rounds + 1):
        z = BIAS + np.bincount(sentence, weight[word], len(doc))
        raw = 1.0 / (1.0 + np.exp(-z))
        p = np.clip((raw - _REST) / (1 - _REST), 1e-9, 1 - 1e-9)
        none = np.exp(np.bincount(doc, np.log1p(-p), len(texts)))
        any_ = np.clip(1 - none, 1e-6, 1 - 1e-9)
        # d(-log likelihood)/dp of a sentence, times dp/dz.
        slope = np.where(y[doc] == 1, -none[doc] / any_[doc], 1.0) / (1 - p) * raw * (1 - raw) / (1 - _REST)
        grad = np.bincount(word, slope[sentence], len(vocab)) / len(texts)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        weight = np.clip(weight - step - rate * penalty * 50, 0.0, 12.0)
    return {w: float(x) for w, x in zip(vocab, weight) if x > 0.5}


def sentence_score(words: list[bytes], weights: dict[bytes, float]) -> float:
    z = BIAS + sum(weights[w] for w in set(words) if w in weights)
    return (1.0 / (1.0 + np.exp(-z)) - _REST) / (1 - _REST) if z > BIAS else 0.0


def sentence_scores(text: bytes | None, weights: dict[bytes, float]) -> list[tuple[int, float]]:
    """Place among the sentences that have a word, and score, of every sentence that scores over 0."""
    data = (text or b"").translate(TABLE)
    if weights.keys().isdisjoint(data.split()):
        return []
    parts = [words for words in map(bytes.split, data.split(b"\n")) if words]
    found = [(k, float(sentence_score(words, weights))) for k, words in enumerate(parts)]
    return [x for x in found if x[1] > 0]


def document_score(text: bytes | None, weights: dict[bytes, float]) -> float:
    return 1.0 - float(np.prod([1.0 - x for _, x in sentence_scores(text, weights)]))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, held_out) -> pd.DataFrame:
    """text (bytes) and label of at most limit labelled rows, chosen by hash of the id; both tables keyed by doc_id.

    Of an id's labels the largest holds, of its rows the one with the least text hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The chosen ids are bounded by limit.
    joined = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).cast("binary").alias("text")
    return joined.groupBy("doc_id").agg(first, F.max("label").cast("int").alias("label")).orderBy("doc_id").select("text", "label").toPandas()


def fit_on(docs: DataFrame, labels: DataFrame) -> dict[bytes, float]:
    rows = training_sample(docs, labels, "toxic", SAMPLE_DOCS, held_out())
    return fit([bytes(t) for t in rows["text"]], rows["label"].to_numpy() == 1) if len(rows) else {}


def score(docs: DataFrame, weights: dict[bytes, float], least: float = LEAST) -> DataFrame:
    """doc_id and score of every row's whole text, with its offending sentences.

    offending: place (of the sentence in the text, from 0) and score of each sentence that scores at least ``least``.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(weights)

    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            scores = sentence_scores(text, shared.value)
            found = [{"place": k, "score": x} for k, x in scores if x >= least]
            out.append((1.0 - float(np.prod([1.0 - x for _, x in scores])) if scores else 0.0, found))
        return pd.DataFrame(out, columns=["score", "offending"])

    marked = F.pandas_udf(of, "score double, offending array<struct<place:int,score:double>>")(F.col("text").cast("binary"))
    return docs.select("doc_id", marked.alias("t")).select("doc_id", "t.*")


def sentences(docs: DataFrame, weights: dict[bytes, float], least: float = LEAST) -> DataFrame:
    """doc_id, sentence (as written), place (from 0) and score of the sentences at or over least."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(weights)

    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = [x for x in sentence_scores(text.encode() if text else None, shared.value) if x[1] >= least]
            parts = [x for x in re.split(r"[.!?\n\r]", text) if x.encode().translate(TABLE).split()] if found else []
            out.append([{"sentence": parts[k].strip(), "place": k, "score": x} for k, x in found])
        return pd.Series(out)

    marked = F.pandas_udf(of, "array<struct<sentence:string,place:int,score:double>>")("text")
    return docs.select("doc_id", F.explode(marked).alias("s")).select("doc_id", "s.*")


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 5 == 0
