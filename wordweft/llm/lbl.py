"""A log-bilinear language model, trained in numpy by noise-contrastive estimation.

Every word has a class: each of the ``own`` most frequent words one of its own, other words one of SUFFIXES that their last
bytes choose, the text's end (which also stands before its first token) one. The model predicts a token's class from the
classes of the two tokens before it: with representations R and a matrix for each position, the score of class w after
c2, c1 is (R[c1] C1 + R[c2] C2) . R[w] + b[w]. Inside a suffix class a word has its smoothed frequency, so all words of
the training texts are represented, as many as there are.

Training takes every training token once: rows are dealt by a hash of id and text to ROUNDS rounds, and those of a round
to shards of about SHARD_TOKENS tokens, at most SHARDS of them; in each round every shard goes on from the shared weights
over its texts, in the order of that hash and CHUNK tokens at a time, with noise drawn from the class frequencies, and
Spark averages the shards' weights. These are put on a grid on which sums are exact, so the model depends on the rows
alone, not on how the table is partitioned. What the driver holds is the weights. The normaliser of each pair of context classes is
made once, by matrix products over all classes, in tasks of some rows each, and scoring multiplies the contexts out for
a batch of texts at a time.

Words beyond the ``frequent`` most frequent, whose table is broadcast, get their counts by a join on the word. The bound
changes the work only.

Defined cases: null and empty texts are one end token; without training rows every count is zero and all classes are
alike; words of equal frequency are ordered by themselves; rows with equal or null doc_id are scored apart; texts may have
any length; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, collect_blobs, crc_of_id, most_frequent, prepare, read_blobs, settle

OWN, SUFFIXES = 767, 256
FREQUENT = 1 << 18
SIZE = 24
ROUNDS = 3
#: Tokens of a training step, noise classes drawn for each, and the step's rate.
STEP, NOISE, RATE = 2048, 64, 0.1
#: Tokens of a shard in a round, shards at most, tokens that are shuffled together.
SHARD_TOKENS, SHARDS, CHUNK = 1 << 21, 1 << 12, 1 << 17
#: Steps of the grids of weights and of summed squares in averages.
GRIDS = 2.0**-24, 2.0**-14
END = 0


@dataclass
class Model:
    represent: np.ndarray  # classes x SIZE
    near: np.ndarray  # SIZE x SIZE, for the token before
    far: np.ndarray  # SIZE x SIZE, for the one before it
    bias: np.ndarray

    def contexts(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        return (self.represent @ self.near)[c1] + (self.represent @ self.far)[c2]

    def normalisers(self, c1: int) -> np.ndarray:
        """log of the summed exponentials after (c2, c1), for every c2."""
        n = len(self.bias)
        scores = self.contexts(np.full(n, c1), np.arange(n)) @ self.represent.T + self.bias
        top = scores.max(axis=1)
        return top + np.log(np.exp(scores - top[:, None]).sum(axis=1))


def initial(frequency: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    n = len(frequency)
    matrices = [(np.eye(SIZE) * x + rng.normal(0, 0.02, (SIZE, SIZE))).astype(np.float32) for x in (0.3, 0.15)]
    return Model(rng.normal(0, 0.1, (n, SIZE)).astype(np.float32), *matrices, np.log(frequency).astype(np.float32))


def unseen(model: Model) -> Model:
    """Sums of squared slopes before the first step."""
    return Model(*[np.full_like(w, 1e-3) for w in (model.represent, model.near, model.far, model.bias)])


def train(model: Model, sums: Model, triples: np.ndarray, frequency: np.ndarray, seed: int, rate: float = RATE) -> None:
    """One pass of NCE over rows (c2, c1, w) with Adagrad steps, which change the weights and the sums of squared slopes.

    The noise classes of a step are shared by its tokens.
    """
    rng = np.random.default_rng(seed)
    weights, squares = [[m.represent, m.near, m.far, m.bias] for m in (model, sums)]
    cumulative = np.cumsum(frequency)
    shift = np.log(NOISE * frequency).astype(np.float32)
    for k in range(0, len(triples), STEP):
        c2, c1, w = triples[k : k + STEP].T
        represent, near, far, bias = weights
        r1, r2, rw = represent[c1], represent[c2], represent[w]
        context = r1 @ near + r2 @ far
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(frequency) - 1)
        rn = represent[noise]
        real = (context * rw).sum(axis=1) + bias[w] - shift[w]
        false = context @ rn.T + bias[noise] - shift[noise]
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        back = up[:, None] * rw + down @ rn
        rows = np.concatenate([w, noise, c1, c2])
        slopes = np.concatenate([up[:, None] * context, down.T @ context, back @ near.T, back @ far.T])
        by_class = np.zeros_like(represent)
        np.add.at(by_class, rows, slopes)
        by_bias = np.bincount(w, up, len(bias)) + np.bincount(noise, down.sum(axis=0), len(bias))
        for own, s, g in zip(weights, squares, (by_class, r1.T @ back, r2.T @ back, by_bias)):
            g = (g / np.sqrt(len(w))).astype(np.float32)
            s += g * g
            own += rate * g / np.sqrt(s)


def to_rows(model: Model) -> np.ndarray:
    return np.concatenate([np.column_stack([model.represent, model.bias]), np.column_stack([np.concatenate([model.near, model.far]), np.zeros(2 * SIZE)])])


def from_rows(rows: np.ndarray) -> Model:
    n = len(rows) - 2 * SIZE
    rows = rows.astype(np.float32)
    return Model(*[np.ascontiguousarray(x) for x in (rows[:n, :SIZE], rows[n : n + SIZE, :SIZE], rows[n + SIZE :, :SIZE], rows[:n, SIZE])])


def suffix(word: bytes) -> int:
    return crc32(word[-3:]) % SUFFIXES


def word_counts(train_docs: DataFrame) -> DataFrame:
    """word (binary), n over all training texts; the end tokens aside. Each batch of texts is counted before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            words = split_words(batch.column(0)).flatten()
            found = words.filter(pc.not_equal(words, "")).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "n"])
            del words, found
            pa.default_memory_pool().release_unused()

    return train_docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case words between ASCII white space; some may be empty, none for null."""
    import pyarrow.compute as pc

    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


@dataclass
class Vocabulary:
    """The frequent words with their counts and classes, by falling count, then by word."""

    names: pa.Array
    counts: np.ndarray
    own: int  # how many of the names have a class of their own

    def classes(self) -> np.ndarray:
        """Class of each name, and of what is none of them at the end: a place for suffix classes."""
        out = np.arange(1, len(self.names) + 2)
        out[self.own :] = [1 + self.own + suffix(x) for x in self.names[self.own :].cast(pa.binary()).to_pylist()] + [0]
        return out


class Reader:
    """Texts as codes of words (the number of names for others) and classes."""

    def __init__(self, vocabulary: Vocabulary):
        self.index, self.classes, self.first = WordIndex(vocabulary.names), vocabulary.classes(), 1 + vocabulary.own

    def read(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts, and for each word its text, its code and its class."""
        import pyarrow.compute as pc

        lists = split_words(texts)
        flat = lists.flatten()
        text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "")
        flat, text = flat.filter(real), text[real.to_numpy(zero_copy_only=False)]
        flat = flat.dictionary_encode()
        spot = self.index.places(flat.dictionary)
        kind = self.classes[spot]
        other = np.flatnonzero(spot < 0)
        kind[other] = [self.first + suffix(x) for x in flat.dictionary.take(pa.array(other)).cast(pa.binary()).to_pylist()]
        spot[other] = len(self.index.names)
        at = flat.indices.to_numpy(zero_copy_only=False)
        code, kind = spot[at], kind[at]
        return flat, text, code, kind


def triples_of(text: np.ndarray, kind: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (c2, c1, w) of all tokens, the ends included, and the text of each."""
    sizes = np.bincount(text, minlength=texts)
    # Each text's classes stand between two ends before and one after.
    at = np.arange(len(kind)) + 3 * text + 2
    padded = np.full(len(kind) + 3 * texts, END)
    padded[at] = kind
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    token = np.ones(len(padded), bool)
    token[starts] = token[starts + 1] = False
    token = np.flatnonzero(token)
    return np.stack([padded[token - 2], padded[token - 1], padded[token]], axis=1), np.repeat(np.arange(texts), sizes + 1)


class Shard:
    """Weights of a shard in a round, on their way through its tokens."""

    def __init__(self, state: np.ndarray, frequency: np.ndarray):
        self.own, self.sums = from_rows(state[:, : SIZE + 1]), from_rows(state[:, SIZE + 1 :])
        self.frequency, self.number, self.held = frequency, 0, np.zeros((0, 3), np.int64)

    def learn(self, triples: np.ndarray, last: bool = False) -> None:
        """Train on all full chunks, and on what is left after the last tokens."""
        self.held = np.concatenate([self.held, triples])
        while len(self.held) >= CHUNK or (last and len(self.held)):
            some, self.held = self.held[:CHUNK], self.held[CHUNK:]
            train(self.own, self.sums, np.random.default_rng(self.number).permutation(some), self.frequency, self.number)
            self.number += 1

    def rows(self) -> pa.RecordBatch:
        self.learn(self.held[:0], last=True)
        rows = np.column_stack([np.round(to_rows(m).astype(np.float64) / g) * g for m, g in zip((self.own, self.sums), GRIDS)])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["row", "weights"])


def fit(train_docs: DataFrame, vocabulary: Vocabulary, frequency: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Model:
    """Weights from all training rows (doc_id, text), each token once; tokens: how many there are."""
    spark = train_docs.sparkSession
    model = initial(frequency)
    state = np.column_stack([to_rows(model), to_rows(unseen(model))])
    words = spark.sparkContext.broadcast(vocabulary)
    width = 2 * (SIZE + 1)
    shards = max(1, min(SHARDS, -(-tokens // (rounds * SHARD_TOKENS))))
    place = F.xxhash64("doc_id", "text")
    dealt = train_docs.select("text", place.alias("place")).select(F.pmod("place", F.lit(rounds)).alias("round"), F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"), "place", "text")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reader, now, shard = Reader(words.value), None, None
            for batch in batches:
                _, text, _, kind = reader.read(batch.column(1))
                triples, of_text = triples_of(text, kind, batch.num_rows)
                # Rows come shard by shard.
                numbers, starts = np.unique(batch.column(0).to_numpy(), return_index=True)
                cuts = np.searchsorted(of_text, [*starts, batch.num_rows])
                for number, lo, hi in zip(numbers, cuts, cuts[1:]):
                    if number != now:
                        if shard:
                            yield shard.rows()
                        now, shard = number, Shard(shared.value, frequency)
                    shard.learn(triples[lo:hi])
                del text, kind, triples, of_text
                pa.default_memory_pool().release_unused()
            if shard:
                yield shard.rows()

        mine = dealt.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "place")
        share = mine.select("shard", "text").mapInArrow(learn, "row int, weights array<double>")
        mean = [F.avg(F.get("weights", F.lit(j))).alias(f"w{j}") for j in range(width)]
        # As many rows as classes and matrices have.
        found = share.groupBy("row").agg(*mean).orderBy("row").select(*[f"w{j}" for j in range(width)]).toPandas().to_numpy()
        state = found if len(found) else state
    return from_rows(state[:, : SIZE + 1])


def normaliser_table(spark, model: Model) -> np.ndarray:
    """log normaliser for each (c1, c2): a matrix product for each c1, in tasks."""
    n = len(model.bias)
    shared = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([shared.value.normalisers(c).astype("<f4").tobytes()], pa.binary())], ["c", "row"])

    rows = spark.range(0, n, 1, spark.sparkContext.defaultParallelism).mapInArrow(of, "c long, row binary")
    table = read_blobs(collect_blobs(rows))
    order = np.argsort(table["c"].to_numpy())
    return np.stack([np.frombuffer(x, "<f4") for x in table["row"].take(pa.array(order)).to_pylist()])


def score(docs: DataFrame, training, frequent: int = FREQUENT, own: int = OWN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; training is the condition of training rows."""
    spark = prepare(docs.sparkSession)
    train_docs = docs.where(training).select("doc_id", "text")
    counts = settle(word_counts(train_docs), "word_counts")
    ends = train_docs.count()
    summed = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = summed["n"] + ends, summed["v"] + (1 if ends else 0)
    # The most frequent words, whatever the bound of the table.
    own_rows = counts.orderBy(F.desc("n"), "word").limit(own).collect()
    names, times = [bytes(r["word"]) for r in own_rows], [r["n"] for r in own_rows]
    top, rest = most_frequent(counts, frequent)
    table = read_blobs(collect_blobs(top))
    more = dict(zip(table["word"].to_pylist(), table["n"].to_pylist())) if table else {}
    for w in names:
        more.pop(w, None)
    vocabulary = Vocabulary(pa.array([x.decode() for x in [*names, *more]], pa.string()), np.array([*times, *more.values()], np.int64), own)
    del table, more
    # Tokens and words of each suffix class.
    last = F.crc32(F.substr("word", F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3))) % SUFFIXES
    by_suffix = counts.groupBy(last.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    held, kinds = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in by_suffix:
        held[r["s"]], kinds[r["s"]] = r["n"], r["v"]
    for w, n in zip(names, times):
        s = suffix(w)
        held[s], kinds[s] = held[s] - n, kinds[s] - 1
    of_class = np.concatenate([[ends], times, np.zeros(own - len(times)), held]).astype(np.float64)
    frequency = (of_class + 0.5) / (of_class + 0.5).sum()
    model = fit(train_docs, vocabulary, frequency, total)
    base_down = float(np.log10(total + distinct + 1))
    # What a word's count plus one is divided by inside its class; nothing in a class of one word.
    own_down = np.concatenate([np.zeros(1 + own), np.log10(held + kinds + 1.0)])
    end_base = float(np.log10(ends + 1)) - base_down
    shared = spark.sparkContext.broadcast((vocabulary, model, normaliser_table(spark, model)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, model_, normalisers = shared.value
        reader, known, single = Reader(words_), len(words_.names), words_.own
        logs = np.append(np.log10(words_.counts + 1.0), 0.0)
        near, far = model_.represent @ model_.near, model_.represent @ model_.far
        here, row = TaskContext.get().partitionId() << 40, 0
        kinds_ = pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
        for batch in batches:
            n = batch.num_rows
            flat, text, code, kind = reader.read(batch.column(1))
            triples, of_text = triples_of(text, kind, n)
            scores = np.zeros(n)
            for k in range(0, len(triples), 1 << 16):
                c2, c1, w = triples[k : k + (1 << 16)].T
                got = np.einsum("ij,ij->i", near[c1] + far[c2], model_.represent[w]) + model_.bias[w] - normalisers[c1, c2]
                scores += np.bincount(of_text[k : k + (1 << 16)], got, n) / np.log(10)
            count_log = logs[code]
            scores += np.bincount(text, np.where(kind > single, count_log - own_down[kind], 0.0), n)
            base = np.bincount(text, count_log - base_down, n) + end_base
            sizes = np.bincount(text, minlength=n)
            seen = np.bincount(text, code < known, n).astype(np.int64) + (1 if ends else 0)
            # Words that the table lacks, counted for each text; a blank cannot be in a word, so the texts' own rows meet no count.
            other = np.flatnonzero(code == known)
            names_ = flat.dictionary.cast(pa.binary())
            pair, how_often = np.unique(text[other] * max(len(names_), 1) + flat.indices.to_numpy(zero_copy_only=False)[other], return_counts=True)
            at, which = np.divmod(pair, max(len(names_), 1))
            ids = here + row + np.arange(n)
            row += n
            none = np.zeros(len(pair))
            columns = (
                np.concatenate([ids, ids[at]]),
                [b" %d" % r for r in ids.tolist()] + names_.take(pa.array(which)).to_pylist(),
                np.concatenate([np.zeros(n, np.int64), how_often]),
                batch.column(0).to_pylist() + [None] * len(pair),
                np.concatenate([sizes + 1, none.astype(np.int64)]),
                np.concatenate([seen, none.astype(np.int64)]),
                np.concatenate([base, none]),
                np.concatenate([scores, none]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_)], ["rid", "word", "times", "doc_id", "n_tokens", "n_known", "base", "own"])
            del flat, text, code, kind, triples, of_text, columns, names_
            pa.default_memory_pool().release_unused()

    parts = docs.select("doc_id", "text").mapInArrow(
        measure, "rid long, word binary, times long, doc_id long, n_tokens long, n_known long, base double, own double"
    )
    times_ = F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)
    gained = F.sum(times_ * F.log10(F.coalesce("c", F.lit(0)) + 1))
    joined = parts.join(rest.withColumnRenamed("n", "c"), "word", "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(times_)).alias("n_known"),
        (F.sum("base") + gained).alias("base_score"),
        (F.sum("own") + gained).alias("score"),
    )
    return joined.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 7 == 2
