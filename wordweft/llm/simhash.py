"""SimHash near-duplicates: fingerprints, links within a few bits, components.

Fingerprints are linked through a segment-popcount embedding. A 64-bit fingerprint is cut into 2-bit
segments; its vector holds each segment's number of set bits. The Manhattan distance of two vectors never
exceeds the number of differing bits, so links within ``bits`` lie within Manhattan distance ``bits``. The 32
coordinates are dealt over ``axes`` grid axes. A Manhattan distance of ``bits`` reaches at most ``bits`` axes, so two
linked vectors lie in the same cell of at least one choice of ``axes - bits`` axes, and on the others within the range
that is left: every choice is one grid, a fingerprint has one cell in each, and the join on (grid, cell) keeps pairs
within Manhattan distance ``bits`` over all 32 coordinates. What passes this bound is verified by the exact count of
differing bits; all links are found and no others.

A cell that a dense family of fingerprints shares (over ``hot_cell`` of them) is not joined with itself: its
fingerprints are linked through midpoints instead (two words of distance 4 have a word at distance 2 of both),
which costs a fixed number of rows for each fingerprint whatever the family's size.

Defined cases: null and empty texts have no word and the fingerprint zero, linked like any other; texts of fewer
words than a shingle hash their whole word sequence; equal rows share a fingerprint; a null doc_id stays in its
component and never names it unless no other id is there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from . import jaccard, oddsketch
from .common import Filter, components, filter_words, may_hold, prepare, settle
from .jaccard import shingle_hashes

SEGMENT = 2
_BLOCK = 1 << 15
#: Bytes of an Arrow batch of ``keep_one``, whose workers hold a text's shingles, its parts and a filter as well.
BATCH_BYTES = "1m"


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the lower-cased words' shingles; a bit is set if over half of the hashes set it."""
    return _majority(shingle_hashes(text, width))


def _majority(found: np.ndarray) -> int:
    if not len(found):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), _BLOCK):
        part = found[k : k + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """Fingerprint as a signed long."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(text.cast("binary"))


def _axis_masks(axes: int) -> list[int]:
    """Bits of each grid axis: the 2-bit segments dealt in runs as even as they come."""
    ends = [round(k * (64 // SEGMENT) / axes) * SEGMENT for k in range(axes + 1)]
    return [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(ends, ends[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: Column) -> Column:
    """The embedding, packed: each 2-bit segment replaced with its number of set bits in unary (00, 01, 11).

    Packed like this, the number of bits in which two vectors differ is their Manhattan distance.
    """
    odd, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(next_bit).bitwiseAND(odd)
    both = fp.bitwiseAND(next_bit).bitwiseAND(odd)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors: a lower bound of their fingerprints' differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def axes_for(distinct: int, bits: int) -> int:
    """Grid axes: a size-independent 7 for 4 bits up to 2^25 fingerprints, then one more for each factor of 8.

    More axes give more and smaller cells. Any number over ``bits`` finds every link; only the cost differs.
    """
    return bits + 3 + max(0, (max(distinct, 1).bit_length() - 25 + 2) // 3)


def links(fps: DataFrame, bits: int = 4, hot_cell: int = 4096, axes: int | None = None) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` that differ in at most ``bits`` bits.

    Cells of over hot_cell fingerprints give, instead of all their pairs, enough links to keep the same
    components.
    """
    distinct = fps.count()
    axes = axes or axes_for(distinct, bits)
    masks = _axis_masks(axes)
    grids = list(combinations(range(axes), axes - bits))
    keys = []
    packed = popcounts(F.col("fp"))
    for number, chosen in enumerate(grids):
        mask = 0
        for k in chosen:
            mask |= masks[k]
        keys.append(F.xxhash64(F.lit(number), packed.bitwiseAND(F.lit(_signed(mask)))))
    cells = fps.select("fp", F.explode(F.array(*keys)).alias("cell"))
    # Nearly all cells differ, so counting each would hold and move a row a cell. A crowded cell crowds its class of cells,
    # too: classes are counted first, at an eighth of hot_cell rows on average, and then the cells of crowded classes alone.
    classes = max(1, distinct * len(grids) // max(1, hot_cell // 8))
    classed = cells.withColumn("class", F.pmod("cell", F.lit(classes)))
    full = settle(classed.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select("class"), "full_classes")
    crowded = not full.isEmpty()
    if crowded:
        hot = classed.join(full, "class", "left_semi").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select("cell")
        hot = settle(hot, "hot_cells")
        crowded = not hot.isEmpty()
    cold = cells.join(hot, "cell", "left_anti") if crowded else cells
    left, right = cold.select("cell", F.col("fp").alias("a")), cold.select("cell", F.col("fp").alias("b"))
    near = left.join(right.hint("merge"), "cell").where((F.col("a") < F.col("b")) & (manhattan(popcounts(F.col("a")), popcounts(F.col("b"))) <= bits))
    pairs = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()
    if crowded:
        dense = cells.join(hot, "cell", "left_semi").select("fp").distinct()
        pairs = pairs.unionByName(through_midpoints(dense, bits)).distinct()
    return pairs


def through_midpoints(fps: DataFrame, bits: int) -> DataFrame:
    """Links that join what lies within ``bits`` (even), by way of words at distance ``bits // 2`` of both."""
    if bits % 2:
        raise ValueError("midpoints need an even number of bits")
    flips = [sum(1 << k for k in chosen) for n in range(bits // 2 + 1) for chosen in combinations(range(64), n)]
    balls = fps.select("fp", F.explode(F.expr("array(" + ",".join(f"{_signed(x)}L" for x in flips) + ")")).alias("flip"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = balls.groupBy("mid").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    return balls.join(met.select("mid", "low"), "mid").where("low < fp").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, hot_cell: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed long), component_id.

    component_id is the least doc_id that links lead to.
    """
    prepare(docs.sparkSession)
    marked = settle(docs.select("doc_id", fingerprint_column(F.col("text"), width).alias("fp")), "fingerprints")
    first = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    found = components(links(first.select("fp"), bits, hot_cell))
    rooted = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = settle(rooted.join(named, "root").select("fp", "component_id"), "components")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def described(text: Column, width: int) -> Column:
    """Struct of fp, and of the shingle set's key (a digest) and size n."""

    def of(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, width) for t in texts]
        sets = [np.unique(h.view(np.int64)) for h in hashes]
        fps = np.array([_majority(h) for h in hashes], np.uint64).view(np.int64)
        return pd.DataFrame({"fp": fps, "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": np.array([len(s) for s in sets], np.int64)})

    return F.pandas_udf(of, "fp long, key binary, n long")(text.cast("binary"))


def parts_of(spark, text: Column, width: int, percent: int, frequent: np.ndarray, seed: Column, spared: np.ndarray) -> Column:
    """Array of the shingle set's parts: size n, whole (odd sketch) and the cells of its prefix.

    Null where the filter spared may hold the seed: asked in here, a task needs one Python worker and not two.
    """
    shared = spark.sparkContext.broadcast((frequent, spared))

    def of(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        order, held = jaccard.Prefixes(shared.value[0], percent), Filter(shared.value[1])
        for texts, seeds in columns:
            hashes, out = seeds.to_numpy().view(np.uint64), []
            for text, left_out in zip(texts, np.isin(hashes, held.keep(hashes))):
                if left_out:
                    out.append(None)
                    continue
                found, parts = jaccard.shingle_set(text, width), []
                for m in sorted(jaccard.cuts(len(found), percent)):
                    at = found & (m - 1)
                    whole = oddsketch.parity(at, found.view(np.uint64) >> np.uint64(20), m)
                    for u in range(m):
                        own = found if m == 1 else found[at == u]
                        if len(own):
                            parts.append({"n": len(own), "whole": whole[u], "cells": order.of(own) ^ np.int64(m - 1)})
                out.append(parts)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<struct<n: long, whole: array<long>, cells: array<long>>>")(text.cast("binary"), seed)


def fingerprint_pairs(nodes: DataFrame, bits: int, hot_cell: int) -> DataFrame:
    """Pairs (a, b) of sets to compare, from place, fp and n of distinct sets: the grid's links between fingerprints.

    A set meets the first of its own fingerprint's sets, and that one the first and the last of the linked fingerprints.
    """
    own = F.min(F.struct("place", "n")).alias("first")
    first = settle(nodes.groupBy("fp").agg(own).select("fp", F.col("first.place").alias("low"), F.col("first.n").alias("low_n")), "distinct_fingerprints")
    near = links(first.select("fp"), bits, hot_cell).groupBy("b").agg(F.array_distinct(F.array(F.min("a"), F.max("a"))).alias("ends"))
    near = near.select("b", F.explode("ends").alias("a"))
    for x in "ab":
        near = near.join(first.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}"), F.col("low_n").alias(f"n_{x}")), x)
    same = nodes.join(first, "fp").where("place <> low").select(F.col("low").alias("low_a"), F.col("place").alias("low_b"), F.col("low_n").alias("n_a"), F.col("n").alias("n_b"))
    return near.select(same.columns).unionByName(same)


class _Parts:
    """Links between distinct sets by the parts of which they consist: a stored table of part, place, n, whole, cells."""

    def __init__(self, linker: oddsketch.Linker, parts: DataFrame, percent: int):
        self.linker, self.possible = linker, oddsketch.possible(percent)
        # As in the operator of odd sketches, these are merged at any size.
        self.sketches = parts.select("part", "place", "n", "whole").hint("merge")

    def open(self, cells: DataFrame) -> DataFrame:
        """cell, part, place, root of the cells that still hold several components."""
        roots = self.linker.roots.select(F.col("node").alias("place"), "root")
        members = cells.select("cell", "part", "place").join(roots, "place", "left").withColumn("root", F.coalesce("root", "place"))
        mixed = members.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
        return settle(members.join(mixed, "cell"), "open")

    def confirm(self, met: DataFrame) -> None:
        """Compare whole sets where parts, a and b of a table, may be similar."""
        self.linker.confirm(met.where(self.possible).select(*oddsketch.ordered(F.col("a.place"), F.col("b.place"))).distinct())

    def confirm_star(self, star: DataFrame) -> None:
        """Compare the sets of part and hub."""
        met = star.select("part", "hub").distinct().alias("p").join(self.sketches.alias("a"), F.col("p.part") == F.col("a.part"))
        self.confirm(met.join(self.sketches.alias("b"), F.col("p.hub") == F.col("b.part")))

    def meet(self, cells: DataFrame) -> None:
        """Join all sets with parts that share a cell: first with a hub, then with two by chance, then what is still apart."""
        cells = self.open(cells)
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
        met = cells.join(sizes, "cell").groupBy("part").agg(F.sum("size").alias("met"))
        hubs = cells.join(met, "part").groupBy("cell").agg(F.max_by(F.struct("part", "root"), F.struct("met", "part")).alias("hub"))
        self.confirm_star(cells.join(hubs, "cell").where("root <> hub.root").select("part", F.col("hub.part").alias("hub")))
        cells, before = self.open(cells), cells
        discard(before)
        by_chance = F.struct(F.xxhash64("cell", "part").alias("h"), "part", "root")
        ends = cells.groupBy("cell").agg(F.array(F.min(by_chance), F.max(by_chance)).alias("ends"))
        star = cells.join(ends.select("cell", F.explode("ends").alias("end")), "cell").where("root <> end.root")
        self.confirm_star(star.select("part", F.col("end.part").alias("hub")))
        cells, before = self.open(cells), cells
        discard(before)
        counts = cells.groupBy("cell", "root").agg(F.count("*").alias("size"))
        main = counts.groupBy("cell").agg(F.max(F.struct("size", "root")).alias("main")).select("cell", F.col("main.root").alias("main"))
        sketched = cells.select("cell", "part", "root").join(self.sketches, "part")
        minor = sketched.join(main, "cell").where("root <> main").alias("a")
        self.confirm(minor.join(sketched.alias("b").hint("merge"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.root") != F.col("b.root")) & self.possible))
        discard(cells)


def linked_sets(marked: DataFrame, width: int, percent: int, bits: int, hot_cell: int) -> DataFrame:
    """node, root of the places of distinct sets that have a link: a similarity of at least percent.

    First come the fingerprints' links, confirmed on whole sets. Similar texts may lie further apart than ``bits``; these are
    among the sets that share a cell and are in different components by then, and all of them are bounded or compared.
    """
    spark = marked.sparkSession
    first = settle(marked.where("n > 0").groupBy("key").agg(F.min(F.struct("place", "fp", "n")).alias("s")).select("s.*"), "sets")
    linker = oddsketch.Linker(marked, first, width, percent)
    near = fingerprint_pairs(first, bits, hot_cell)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    linker.confirm(near.where(sized).select(*oddsketch.ordered(F.col("low_a"), F.col("low_b"))))
    # Texts that surely are the first with their set aren't moved.
    copies = marked.where("n > 0").select("place").join(first.select("place").hint("merge"), "place", "left_anti")
    may_be_copies = filter_words(copies.select(F.xxhash64("place").alias("seed")), 32)
    frequent, texts = jaccard.frequent_shingles(marked, width), marked.where("n > 0").select("place", "text")
    asked = texts.where(may_hold(F.col("place"), spark, may_be_copies)).join(first.select("place").hint("merge"), "place", "left_semi")
    cut = [
        some.select("place", F.explode(parts_of(spark, F.col("text"), width, percent, frequent, F.xxhash64("place"), spared)).alias("p"))
        for some, spared in ((texts, may_be_copies), (asked, np.zeros(1, np.uint64)))
    ]
    parts = cut[0].unionByName(cut[1])
    parts = settle(parts.select(F.monotonically_increasing_id().alias("part"), "place", "p.*"), "parts")
    cells = parts.select("part", "place", F.explode("cells").alias("cell"))
    # Forty bits tell cells apart well enough to see which are shared; what only seems to be is left out afterwards.
    code = F.shiftrightunsigned("cell", 24).bitwiseXOR(F.col("cell").bitwiseAND(F.lit(255)))
    shared = settle(cells.groupBy(code.alias("code")).agg(F.count("*").alias("size")).where("size > 1").select(F.xxhash64("code").alias("seed")), "shared_cells")
    met = settle(cells.where(may_hold(code, spark, filter_words(shared, 32))), "cells")
    discard(shared)
    _Parts(linker, parts, percent).meet(met)
    discard(first, parts, met)
    return linker.roots


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 4, hot_cell: int = 4096) -> DataFrame:
    """The rows of docs, one of each component of near copies: the row with the least doc_id.

    Null ids come last; of equal ids the least text hash wins, and one of equal rows. Rows are told apart by place, never
    by doc_id.
    Near copies are texts whose shingles have a Jaccard similarity of at least percent. They are found by fingerprints on the
    grid, confirmed on their sets, and beyond ``bits`` by shared hashes of their prefixes: all such links and no others.
    """
    spark = prepare(docs.sparkSession, BATCH_BYTES)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.monotonically_increasing_id().alias("place"), described(F.col("text"), width).alias("s"))
    marked = settle(marked.select("row", "place", "s.*"), "marked")
    found = linked_sets(marked.withColumn("text", F.col("row.text")), width, percent, bits, hot_cell)
    mark = F.struct(F.col("row.doc_id").isNull().alias("last"), "row.doc_id", F.xxhash64("row.text").alias("hash"), "place").alias("mark")
    sets = marked.groupBy("key").agg(F.min("place").alias("node"))
    rooted = sets.join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rows = marked.select("key", "place", mark).join(rooted, "key").select("root", "place", "mark")
    kept = rows.groupBy("root").agg(F.min("mark").alias("mark")).select("mark.place")
    gone = settle(rows.select("place").join(kept, "place", "left_anti"), "gone")
    # Rows that surely stay aren't moved.
    may_go = may_hold(F.col("place"), spark, filter_words(gone.select(F.xxhash64("place").alias("seed")), 32))
    asked = marked.select("row", "place", may_go.alias("may_go"))
    stay = asked.where("not may_go").select("row.*")
    return stay.unionByName(asked.where("may_go").join(gone, "place", "left_anti").select("row.*"))
