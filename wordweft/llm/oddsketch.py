"""Near copies by MinHash bands and odd sketches, confirmed on full shingle sets.

A text's set is its distinct five-word shingles. ``BANDS * ROWS`` MinHash samples give band keys, under which sets meet, and
are folded into a parity bitmap (odd sketch): bit i counts, modulo 2, the samples that hash to i, so that the bits in which
two sketches differ tell how many samples differ, most precisely where few do. A second bitmap folds the whole set; its
differing bits are never more than the elements that only one set has, so it rejects no true link. What both let pass is
compared set by set.

A band's bucket is never paired out. Each round pairs every member with one other of its bucket, of another component by
then: first with the hub, the member that meets most others in all its buckets, then with two members by chance; so
a group of copies is joined by a row a member. What is still apart after that meets all of its buckets' other components,
but in the join's own condition on the sketches, from which only likely links come out.

At a similarity of 0.85 a pair misses all bands with a chance of 2 in 10^9, and the samples' sketch rejects it with one of
about 1 in 10^8. ``MARGIN``, ``BANDS`` and ``ROWS`` are the same at any size of the corpus.

Defined cases: texts without words and null texts have the empty set and are linked with nothing, not with each other; texts
of fewer than five words have their word sequence as one shingle; rows with equal sets are linked whatever their ids; a
component without any id has a null component_id; null ids are left aside where others are; ``kept`` compares null-safe;
an empty table gives no rows; texts may have any length; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, filter_words, may_hold, prepare, settle
from .jaccard import shingle_set, similar

WIDTH, PERCENT = 5, 85
BANDS, ROWS = 42, 6
#: Bits of a sketch, and how far below the threshold the samples' estimate may lie.
BITS, MARGIN = 1024, 0.13
LONGS = BITS // 64
#: Shingles that meet all samples' multipliers at once.
SLICE = 512
MULTIPLIERS = np.random.default_rng(42).integers(1 << 16, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def min_samples(found: np.ndarray) -> np.ndarray:
    """The set's least value under each multiplier."""
    high = (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), SLICE):
        np.minimum(least, np.multiply.outer(high[k : k + SLICE], MULTIPLIERS).min(axis=0), out=least)
    return least


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def parity(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n odd sketches as longs: the parity of each row's hashes by their last bits."""
    at = rows * BITS + (hashes % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, LONGS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Band keys of rows of samples."""
    cut = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2])
    for k in range(ROWS):
        keys = _mix(keys ^ cut[:, :, k] << np.uint64(8 * (k % 4)))
    return keys.view(np.int64)


def described(text: Column, width: int) -> Column:
    """Struct of n, key (a digest of the set), bands, sample and whole (sketches)."""

    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        n = len(sets)
        samples = np.array([min_samples(s) for s in sets], np.uint32).reshape(n, len(MULTIPLIERS))
        numbered = samples.astype(np.uint64) << np.uint64(16) | np.arange(len(MULTIPLIERS), dtype=np.uint64)
        sizes = np.array([len(s) for s in sets], np.int64)
        rows = np.repeat(np.arange(n), sizes)
        whole = np.concatenate([np.zeros(0, np.int64), *sets]).view(np.uint64)
        drawn = np.repeat(np.arange(n), len(MULTIPLIERS))
        return pd.DataFrame({
            "n": sizes, "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": list(band_keys(samples)),
            "sample": list(parity(drawn, _mix(numbered.ravel()) >> np.uint64(20), n)), "whole": list(parity(rows, whole, n)),
        })

    return F.pandas_udf(of, "n long, key binary, bands array<long>, sample array<long>, whole array<long>")(text.cast("binary"))


def _differing(name: str) -> Column:
    """Bits in which the sketches of a and b differ."""
    each = [F.bit_count(F.get(f"a.{name}", F.lit(i)).bitwiseXOR(F.get(f"b.{name}", F.lit(i)))) for i in range(LONGS)]
    return sum(each[1:], each[0])


def sample_limit(percent: int) -> int:
    """Differing bits of sample sketches at which the estimated similarity is MARGIN below percent."""
    apart = 1 - percent / 100 + MARGIN
    return math.floor(BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * apart / BITS)))


def possible(percent: int) -> Column:
    """Whether sizes and whole sketches of a and b leave room for a similarity of percent; true of all that have it."""
    small, big = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    whole = _differing("whole") * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)
    return (small * 100 >= big * percent) & whole


def likely(percent: int) -> Column:
    """Whether sketches and sizes of a and b leave room for a similarity of percent."""
    return possible(percent) & (_differing("sample") <= sample_limit(percent))


class Linker:
    """Links between the sets of a stored table with place, text and the columns of ``described``."""

    def __init__(self, marked: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.marked, self.width, self.percent = marked, width, percent
        self.sketches = nodes
        self.found: DataFrame | None = None
        self.roots: DataFrame | None = None

    def pairs_likely(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sketches allow a link."""
        # Sketches grow with the corpus: they are merged at any size, never broadcast because they are still small.
        a, b = [self.sketches.alias(x).hint("merge") for x in "ab"]
        met = pairs.alias("p").join(a, F.col("p.a") == F.col("a.place")).join(b, F.col("p.b") == F.col("b.place"))
        return met.where(likely(self.percent)).select("p.a", "p.b")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the sets of the pairs, and join what is linked."""
        pairs = settle(pairs, "pairs")
        seeds = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("seed"))
        held = may_hold(F.col("place"), pairs.sparkSession, filter_words(seeds, 32))
        texts = self.marked.where(held).select("place", F.col("text").cast("binary").alias("text"))
        both = pairs.join(texts.select(F.col("place").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("place").alias("b"), F.col("text").alias("text_b")), "b")
        links = settle(both.where(similar(self.width, self.percent)("text_a", "text_b")).select("a", "b"), "links")
        self.found = links if self.found is None else self.found.unionByName(links)
        self.roots = settle(components(self.found), "roots")

    def open_members(self, cells: DataFrame) -> DataFrame:
        """cell, place, root of the buckets that still hold several components."""
        roots = self.roots.select(F.col("node").alias("place"), "root")
        members = cells.join(roots, "place", "left").select("cell", "place", F.coalesce("root", "place").alias("root"))
        mixed = members.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
        return settle(members.join(mixed, "cell"), "open")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked_sets(marked: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): key and place of each distinct set, and node, root of every place that has a link."""
    first = settle(marked.where("n > 0").groupBy("key").agg(F.min("place").alias("place")), "sets")
    # As with sketches: the same plan at any size.
    own = first.select("place").hint("merge")
    nodes = settle(marked.select("place", "n", "sample", "whole").join(own, "place", "left_semi"), "nodes")
    linker = Linker(marked, nodes, width, percent)
    cells = marked.select("place", "bands").join(own, "place", "left_semi").select("place", F.explode("bands").alias("cell"))
    sizes = settle(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    # Few buckets hold more than one set; a filter of bounded size keeps most of the other rows from being moved.
    shared = filter_words(sizes.select(F.xxhash64("cell").alias("seed")), 32)
    cells = settle(cells.where(may_hold(F.col("cell"), marked.sparkSession, shared)).join(sizes, "cell"), "cells")
    met = cells.groupBy("place").agg(F.sum("size").alias("met"))
    ranked = cells.select("cell", "place").join(met, "place")
    hubs = ranked.groupBy("cell").agg(F.max_by("place", F.struct("met", "place")).alias("hub"))
    star = cells.select("cell", "place").join(hubs, "cell").where("place <> hub").select(*ordered(F.col("place"), F.col("hub"))).distinct()
    linker.confirm(linker.pairs_likely(star))
    cells = linker.open_members(cells)
    by_chance = F.struct(F.xxhash64("cell", "place").alias("h"), "place", "root")
    ends = cells.groupBy("cell").agg(F.min(by_chance).alias("lo"), F.max(by_chance).alias("hi"))
    star = cells.join(ends.select("cell", F.explode(F.array("lo", "hi")).alias("end")), "cell").where("root <> end.root")
    linker.confirm(linker.pairs_likely(star.select(*ordered(F.col("place"), F.col("end.place"))).distinct()))
    cells = linker.open_members(cells.select("cell", "place"))
    counts = cells.groupBy("cell", "root").agg(F.count("*").alias("size"))
    main = counts.groupBy("cell").agg(F.max(F.struct("size", "root")).alias("main")).select("cell", F.col("main.root").alias("main"))
    sketched = cells.join(linker.sketches.hint("merge"), "place")
    minor = sketched.join(main, "cell").where("root <> main").alias("a")
    rest = minor.join(sketched.alias("b").hint("merge"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.root") != F.col("b.root")) & likely(percent))
    linker.confirm(rest.select(*ordered(F.col("a.place"), F.col("b.place"))).distinct())
    return first, linker.roots


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    prepare(docs.sparkSession)
    told = docs.select("doc_id", "text", described(F.col("text"), width).alias("s"))
    marked = settle(told.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text", "s.*"), "marked")
    first, roots = linked_sets(marked, width, percent)
    low = marked.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    named = first.join(low, "key").join(roots.withColumnRenamed("node", "place"), "place", "left").select("key", "low", F.coalesce("root", "place").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "root").select("key", "component_id", F.lit(True).alias("linked"))
    out = marked.select("doc_id", F.col("n").alias("n_shingles"), "key").join(classes, "key", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
