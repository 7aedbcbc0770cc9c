"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, marks and digits under full case folding; in scripts that are written without blanks each
character is one. Windows of MATCH tokens are hashed the Karp-Rabin way and are the seeds: the benchmark's seeds are a
table, a Bloom filter of it, of bounded size, tells which windows of a text may be seeds, and only those are
joined to the table. Each pair of text and item that shares enough seeds is tiled: matches of free tokens are marked from
the longest on, search lengths going down by halves, so a passage whose sentences were put in another order is covered by
several tiles. An item is found in a text if tiles cover at least ``COVERAGE`` of its tokens.

Items of fewer than MATCH tokens are found where all their tokens stand one after another.

Defined cases: null and empty texts match nothing, nor do items that are null or have no token; equal items are found
together; repeated rows are judged apart; among equally long matches the first in the text, then in the item is marked;
a null doc_id or item_id is kept; other columns are ignored (``contaminated``) or kept (``keep_clean``).
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, filter_words, prepare, settle

MATCH = 5
COVERAGE = 0.5
#: Tokens whose numbers a worker remembers, and pairs of windows that are looked at together.
REMEMBERED, PAIRS = 200_000, 1 << 20
#: Lower case is folded before; other ASCII characters than letters and digits become blanks.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _patterns():
    import regex

    blankless = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    odd = regex.compile(rf"[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]|[{blankless}]")
    word = regex.compile(rf"(?V1)[\p{{L}}\p{{N}}&&[{blankless}]]\p{{M}}*|[\p{{L}}\p{{M}}\p{{N}}--[{blankless}]]+")
    return odd, word


def tokens(text: str | None) -> list[bytes]:
    low = (text or "").casefold()
    odd, word = _patterns()
    if odd.search(low):
        return [w.encode() for w in word.findall(low)]
    return low.encode().translate(TABLE).split()


_numbers: dict[bytes, int] = {}


def numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each token, the same in every process."""
    if len(_numbers) > REMEMBERED:
        _numbers.clear()
    digest = xxhash.xxh64_intdigest
    out = []
    for w in words:
        n = _numbers.get(w)
        if n is None:
            n = _numbers[w] = digest(w, 7)
        out.append(n)
    return np.array(out, np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of ``size`` ids: differences of running sums, one product a step."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * powers(_BASE, len(ids)), dtype=np.uint64, out=sums[1:])
    return (sums[size:] - sums[:-size]) * powers(_INVERSE, n)


def seeds(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows, apart for each size; spread over all bits."""
    found = rolling(ids, size) * np.uint64(2) + np.uint64(size)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def tile(text: np.ndarray, item: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length), each the longest left; zeros in text match nothing."""
    free_text, free_item = text != 0, np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    size = min(len(item), len(text))
    while size >= least:
        heap = [(-_length(text, item, free_text, free_item, t, i), t, i) for t, i in _starts(text, item, free_text, free_item, size)]
        heapq.heapify(heap)
        while heap:
            n, t, i = heapq.heappop(heap)
            free = free_text[t : t - n] & free_item[i : i - n]
            if free.all():
                free_text[t : t - n] = free_item[i : i - n] = False
                found.append((t, i, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= size:
                    heapq.heappush(heap, (a - b, t + a, i + a))
        size = size // 2 if size >= 2 * least else least if size > least else 0
    return found


def _starts(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where runs of at least size equal free tokens start, in text and item."""
    ours, theirs = np.flatnonzero(_runs(free_text, size)), np.flatnonzero(_runs(free_item, size))
    if not len(ours) or not len(theirs):
        return []
    mine, other = rolling(text, size)[ours], rolling(item, size)[theirs]
    order = np.argsort(other, kind="stable")
    other, theirs = other[order], theirs[order]
    low, high = np.searchsorted(other, mine, "left"), np.searchsorted(other, mine, "right")
    met = np.flatnonzero(high > low)
    out: list[tuple[int, int]] = []
    counts = (high - low)[met]
    for part in np.split(met, np.searchsorted(np.cumsum(counts), np.arange(PAIRS, int(counts.sum()), PAIRS))):
        n = (high - low)[part]
        t = np.repeat(ours[part], n)
        i = theirs[np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        inner = (t > 0) & (i > 0)
        before = np.where(inner, t - 1, 0), np.where(inner, i - 1, 0)
        inner &= (text[before[0]] == item[before[1]]) & free_text[before[0]] & free_item[before[1]]
        for a, b in zip(t[~inner].tolist(), i[~inner].tolist()):
            if (text[a : a + size] == item[b : b + size]).all():
                out.append((a, b))
    return out


def _length(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, t: int, i: int) -> int:
    """How long the run of equal free tokens is."""
    n, step = 0, 64
    while True:
        k = min(step, len(text) - t - n, len(item) - i - n)
        a, b = t + n, i + n
        same = (text[a : a + k] == item[b : b + k]) & free_text[a : a + k] & free_item[b : b + k]
        if k <= 0 or not same.all():
            return n + (int(same.argmin()) if k > 0 else 0)
        n, step = n + k, 2 * step


def _runs(free: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` free places start."""
    if len(free) < size:
        return np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[size:] - sums[:-size] == size


def covered(text: list[bytes], item: list[bytes], least: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of both, equal for equal tokens: of the item, and of the text's tokens in windows that the item has, too.

    Runs of the text are parted by zeros.
    """
    place: dict[bytes, int] = {}
    theirs = np.array([place.setdefault(w, len(place) + 1) for w in item], np.uint64)
    ours = np.array([place.get(w, 0) for w in text], np.uint64)
    windows = np.flatnonzero(_runs(ours != 0, least))
    windows = windows[np.isin(rolling(ours, least)[windows], rolling(theirs, least))] if len(windows) else windows
    on = np.zeros(len(ours) + 1, np.int64)
    np.add.at(on, windows, 1)
    np.add.at(on, windows + least, -1)
    on = np.cumsum(on)[:-1] > 0
    starts = on & ~np.concatenate([[False], on[:-1]]) if len(on) else on
    return np.insert(ours[on], np.flatnonzero(starts[on]), 0), theirs


def compare(text: list[bytes], item: list[bytes], least: int = MATCH) -> tuple[int, int]:
    """Tokens of the item that tiles cover, and the longest tile."""
    if len(item) < least:
        first = item[0] if item else None
        at = any(w == first and text[k : k + len(item)] == item for k, w in enumerate(text))
        return (len(item), len(item)) if at else (0, 0)
    tiles = tile(*covered(text, item, least), least)
    return sum(n for _, _, n in tiles), max((n for _, _, n in tiles), default=0)


def item_table(benchmark: DataFrame, least: int = MATCH) -> DataFrame:
    """item (the row's number), item_id, text, n (tokens) and seeds of the items that have a token."""

    def of(texts: pd.Series) -> pd.DataFrame:
        found = [numbers(tokens(t)) for t in texts]
        own = [seeds(x, min(least, len(x))).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in found]
        return pd.DataFrame({"n": np.array([len(x) for x in found], np.int32), "seeds": own})

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    marked = rows.withColumn("m", F.pandas_udf(of, "n int, seeds array<long>")("text"))
    return settle(marked.select("item", "item_id", "text", "m.n", "m.seeds").where("n > 0"), "items")


def seeds_column(text: Column, spark, words: np.ndarray, sizes: list[int]) -> Column:
    """The text's distinct seeds that the filter lets through."""
    shared = prepare(spark).sparkContext.broadcast(words)

    def of(texts: pd.Series) -> pd.Series:
        own = Filter(shared.value)
        out = []
        for t in texts:
            ids = numbers(tokens(t))
            out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[own.keep(seeds(ids, k)) for k in sizes]])).view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(of, "array<long>")(text)


def found_items(marked: DataFrame, items: DataFrame, coverage: float, least: int = MATCH) -> DataFrame:
    """place, item_id, tiled, longest, coverage from rows (place, text, seeds): the seed join and the tiling."""
    table = items.select("item", "n", F.explode("seeds").alias("seed")).groupBy("item", "n", "seed").agg(F.count("*").alias("times"))
    met = marked.select("place", F.explode("seeds").alias("seed")).join(table, "seed")
    # Tiles lie in windows that are shared.
    pairs = met.groupBy("place", "item", "n").agg((F.sum("times") * least).alias("most")).where(F.col("most") >= coverage * F.col("n"))
    both = pairs.select("place", "item", "n").join(marked.select("place", "text"), "place")
    both = both.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def search(texts: pd.Series, item_texts: pd.Series) -> pd.DataFrame:
        last, words, out = None, [], []
        for text, item in zip(texts, item_texts):
            if text is not last:
                last, words = text, tokens(text)
            out.append(compare(words, tokens(item), least))
        return pd.DataFrame(out, columns=["tiled", "longest"]).astype("int32")

    tiled = both.withColumn("f", F.pandas_udf(search, "tiled int, longest int")("text", "item_text"))
    share = F.col("f.tiled") / F.col("n")
    return tiled.where((F.col("f.tiled") > 0) & (F.col("f.tiled") >= coverage * F.col("n"))).select("place", "item_id", "f.tiled", "f.longest", share.alias("coverage"))


def _prepared(benchmark: DataFrame) -> tuple[DataFrame, np.ndarray, list[int]]:
    items = item_table(benchmark)
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(MATCH))).distinct().collect())
    return items, filter_words(items.select(F.explode("seeds").alias("seed"))), sizes


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, tiled (tokens), longest (tile), coverage for each item found in a text."""
    spark = prepare(docs.sparkSession)
    items, words, sizes = _prepared(benchmark)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    marked = settle(rows.withColumn("seeds", seeds_column(F.col("text"), spark, words, sizes)).where(F.size("seeds") > 0), "seeded")
    return found_items(marked, items, coverage).join(marked.select("place", "doc_id"), "place").select("doc_id", "item_id", "tiled", "longest", "coverage")


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs in which no item is found, with their own columns alone."""
    spark = prepare(docs.sparkSession)
    items, words, sizes = _prepared(benchmark)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    marked = settle(row.withColumn("seeds", seeds_column(F.col("row.text"), spark, words, sizes)), "seeded")
    seeded = marked.where(F.size("seeds") > 0).select("place", F.col("row.text").alias("text"), "seeds")
    bad = found_items(seeded, items, coverage).select("place").distinct()
    return marked.join(bad, "place", "left_anti").select("row.*")
