"""Sets of word shingles, their prefixes, and exact Jaccard similarity.

A text's set is the distinct 64-bit hashes of its lower-cased words' shingles, put in an order that is the same for
all texts. Two sets with similarity of at least ``percent`` share a hash within the first n - ceil(percent n / 100) + 1
of each (n: the set's size), so that sets which meet by no hash of their prefixes are no near copies.

The order is by hash, but hashes that many texts of a sample share come last, the most frequent at the very end, so
that boilerplate seldom is in a prefix. The sample changes the cost only, never what meets.

Large sets share some hash with many unlike sets, and no sketch of a fixed size tells these apart. So they are cut into
parts by their hashes' last bits: of two sets with the similarity, some part of one has it to the same part of the other.

Defined cases: null and empty texts have the empty set, all of them equal; texts of fewer words than a shingle have
their whole word sequence as one shingle; texts may have any length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_blobs, read_blobs

SEED = 42
#: Texts looked at for frequent shingles, in how many of them one is frequent, and how many are held at most.
SAMPLE_DOCS, FREQUENT_IN, FREQUENT = 4_000, 8, 1 << 16
#: Sets of over 2^PART_BITS hashes are cut into parts.
PART_BITS = 10


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of all shingles of the lower-cased words, in order, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The text's set, ascending, as signed longs."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes in many texts of a sample, by rising frequency."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))

    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width) for t in texts])

    some = docs.select(F.col("text").cast("binary").alias("text")).sample(share, seed=1).distinct()
    counts = some.select(F.explode(F.pandas_udf(sets, "array<long>")("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    top = read_blobs(collect_blobs(counts.where(F.col("n") >= FREQUENT_IN).orderBy(F.desc("n"), "h").limit(FREQUENT)))
    if top is None:
        return np.zeros(0, np.int64)
    h, n = top["h"].to_numpy(), top["n"].to_numpy()
    return h[np.lexsort((h, n))]


class Prefixes:
    """Prefixes of sets under one order: frequent hashes last."""

    def __init__(self, frequent: np.ndarray, percent: int):
        self.percent, self.place = percent, np.argsort(frequent)
        self.ordered = frequent[self.place]

    def of(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        if len(self.ordered):
            at = np.minimum(np.searchsorted(self.ordered, found), len(self.ordered) - 1)
            found = found[np.argsort(np.where(self.ordered[at] == found, self.place[at], -1), kind="stable")]
        return found[: n - (self.percent * n + 99) // 100 + 1]


def cuts(n: int, percent: int) -> set[int]:
    """Into how many parts a set of n hashes is cut: by its own size, and by that of the largest set it may be similar to."""
    return {1 << max(0, (x - 1).bit_length() - PART_BITS) for x in (n, n * 100 // percent)} if n else set()


def similar(width: int, percent: int):
    """Column function of two texts: whether their sets' similarity is at least percent."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = [lru_cache(maxsize=64)(lambda t: shingle_set(t, width)) for _ in "ab"]

        def check(x: bytes | None, y: bytes | None) -> bool:
            p, q = one(x), two(y)
            common = len(np.intersect1d(p, q, assume_unique=True))
            return common * (100 + percent) >= (len(p) + len(q)) * percent

        return pd.Series([check(x, y) for x, y in zip(a, b)], dtype=bool)

    return F.pandas_udf(of, "boolean")
