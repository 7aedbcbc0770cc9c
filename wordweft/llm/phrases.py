"""Phrase collocations: n-grams counted in burst tries, merged by Spark in prefix partitions, scored by their weakest cut.

A task numbers the words it meets and counts n-grams in a trie over word ids: one small hash container for each first
word, which bursts into containers by second word once it is crowded. When a task holds ``HELD`` n-grams, whole subtrees,
the largest first, are spilled as sorted runs of (phrase, count) until half are left. Runs are dealt out by the phrase's
prefix (its first two words; the continuations of one prefix over ``FAN`` parts, so that no prefix fills a partition) and
merged there by Spark's own aggregation, so nothing is lost however often a task spills or is run again.

Counts of at least ``least`` are kept for scoring, which is exact: a part of a phrase is met at least as often as the phrase.
For the same reason longer phrases are counted after the pairs, and only where each of their pairs may be frequent by a Bloom
filter of bounded size: a false hit costs a row, and a filter that is too full for its corpus lets all rows through.
Products are decimals of 38 digits: exact for counts below 10^15.

Defined cases: null texts are empty; a null language is ``und``; only A-Z are lower-cased; texts may have any length (a
text is one batch at least, its words are held once); repeated rows count as often as they stand; an empty table has no
phrases; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PROBES, filter_words, prepare, settle

#: n-grams that a task holds before it spills, words it numbers before it starts anew, and entries at which a container bursts.
HELD, WORDS, BURST = 1_500_000, 1 << 19, 4096
#: Parts that one prefix's continuations are dealt over; rows that one task ranks.
FAN, RANKED = 16, 1 << 16
#: Bits of the filter of frequent pairs for each of them; ``filter_words`` bounds the whole.
PAIR_BITS = 32
ID_BITS = 20
MASK = (1 << ID_BITS) - 1
#: Pieces end at these bytes; blanks and tabs part words.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"\t" + SEPARATORS, b" " + b"\n" * len(SEPARATORS))
RUN = pa.schema([("lang", pa.string()), ("prefix", pa.int64()), ("phrase", pa.string()), ("n", pa.int64())])


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words in order; a line feed stands between pieces, empty strings may stand anywhere."""
    return text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


class BurstTrie:
    """Counts of packed n-grams (three word ids, 0: none) below their first word.

    A child of the root is a container (dict from packed n-gram to count) or, once burst, a dict of containers by the
    second word.
    """

    def __init__(self):
        self.leaves: dict[int, dict[int, int]] = {}
        self.burst: dict[int, dict[int, dict[int, int]]] = {}
        self.held = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Distinct packed n-grams, ascending, with their counts."""
        first = grams >> (2 * ID_BITS)
        edges = np.flatnonzero(np.diff(first, prepend=-1, append=-1))
        keys, values = grams.tolist(), counts.tolist()
        for a, b, head in zip(edges[:-1].tolist(), edges[1:].tolist(), first[edges[:-1]].tolist()):
            if head in self.burst:
                inner = self.burst[head]
                for k in range(a, b):
                    self._into(inner.setdefault(keys[k] >> ID_BITS & MASK, {}), keys, values, k, k + 1)
                continue
            leaf = self.leaves.setdefault(head, {})
            self._into(leaf, keys, values, a, b)
            if len(leaf) > BURST:
                inner = self.burst[head] = {}
                for key, value in self.leaves.pop(head).items():
                    inner.setdefault(key >> ID_BITS & MASK, {})[key] = value

    def _into(self, leaf: dict[int, int], keys: list[int], values: list[int], a: int, b: int) -> None:
        before, get = len(leaf), leaf.get
        for k in range(a, b):
            leaf[keys[k]] = get(keys[k], 0) + values[k]
        self.held += len(leaf) - before

    def subtree_sizes(self) -> list[tuple[int, int]]:
        """(n-grams held, first word) of the root's children."""
        burst = [(sum(map(len, inner.values())), head) for head, inner in self.burst.items()]
        return burst + [(len(leaf), head) for head, leaf in self.leaves.items()]

    def take(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, the largest first, until at most ``left`` n-grams stay: packed n-grams and counts."""
        grams, counts = [], []
        for size, head in sorted(self.subtree_sizes(), reverse=True):
            if self.held <= left:
                break
            leaves = self.burst.pop(head).values() if head in self.burst else [self.leaves.pop(head)]
            for leaf in leaves:
                grams.extend(leaf)
                counts.extend(leaf.values())
            self.held -= size
        return np.array(grams, np.int64), np.array(counts, np.int64)


class PhraseCounter:
    """One task's tries by language over one numbering of words; counts phrases of ``sizes`` words.

    pairs: words of a Bloom filter of the prefixes of frequent pairs, or None to count all phrases.
    """

    def __init__(self, sizes: tuple[int, ...], pairs: np.ndarray | None = None, held: int = HELD, words: int = WORDS):
        self.sizes, self.pairs, self.limit, self.words = sizes, pairs, held, min(words, MASK - 2)
        self._anew()

    def _anew(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        # Empty strings are nothing, a line feed parts pieces.
        for mark in (b"", b"\n"):
            self.ids[mark]
        self.hashes = np.zeros(0, np.uint64)
        self.tries: dict[str, BurstTrie] = defaultdict(BurstTrie)

    def word_hashes(self) -> np.ndarray:
        """A hash of each numbered word; only new words are hashed."""
        fresh = list(islice(self.ids, len(self.hashes), None))
        if fresh:
            self.hashes = np.concatenate([self.hashes, hash_words(pa.array(fresh, pa.binary()).cast(pa.string()))])
        return self.hashes

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        ids = ids[ids > 0]
        grams, inside, packed, linked = [], ids > 1, ids << (2 * ID_BITS), None
        if self.pairs is not None:
            own = self.word_hashes()[ids]
            linked = maybe_in(self.pairs, prefixes(lang, own[:-1], own[1:], np.zeros(1, np.uint64)))
        for k in range(max(self.sizes)):
            if k:
                inside, packed = inside[:-1] & (ids[k:] > 1), packed[:-1] | ids[k:] << ((2 - k) * ID_BITS)
            if k and linked is not None:
                inside &= linked[k - 1 :]
            if k + 1 in self.sizes:
                grams.append(packed[inside])
        if sum(map(len, grams)):
            self.tries[lang].add(*np.unique(np.concatenate(grams), return_counts=True))

    def full(self) -> bool:
        return len(self.ids) > self.words or sum(t.held for t in self.tries.values()) > self.limit

    def spill(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what has to go; a new numbering if the old one is used up."""
        everything |= len(self.ids) > self.words
        held = sum(t.held for t in self.tries.values())
        names = pa.array(list(self.ids), pa.binary())
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        sorted_names, rank[0] = names.take(pa.array(order)).cast(pa.string()), 0
        hashes = self.word_hashes()[order]
        for lang, trie in self.tries.items():
            share = 0 if everything else trie.held * (self.limit // 2) // max(held, 1)
            grams, counts = trie.take(share)
            yield from sorted_run(lang, grams, counts, rank, sorted_names, hashes)
        if everything:
            self._anew()


def sorted_run(lang: str, grams: np.ndarray, counts: np.ndarray, rank: np.ndarray, names: pa.StringArray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``RUN`` in the order of the phrases' words; rank: from word id to place from 1, 0 for no word."""
    ranks = [rank[grams >> (s * ID_BITS) & MASK] for s in (2, 1, 0)]
    place = np.argsort(ranks[0] << (2 * ID_BITS) | ranks[1] << ID_BITS | ranks[2])
    for k in range(0, len(place), 1 << 16):
        at = place[k : k + (1 << 16)]
        own = [r[at] for r in ranks]
        phrase = pc.binary_join_element_wise(*[names.take(pa.array(r - 1, mask=r == 0)) for r in own], " ", null_handling="skip")
        one, two, three = [np.where(r > 0, hashes[r - 1], np.uint64(0)) for r in own]
        prefix = prefixes(lang, one, two, three % np.uint64(FAN))
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(prefix.view(np.int64)), phrase, pa.array(counts[at])], schema=RUN)


def hash_words(words: pa.StringArray) -> np.ndarray:
    """A hash of each word, the same in every task."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def prefixes(lang: str, one: np.ndarray, two: np.ndarray, fan: np.ndarray) -> np.ndarray:
    """The part of phrases with these hashes of their first words (0: none) and this share of the continuations."""
    mixed = (one * np.uint64(0x9E3779B97F4A7C15) + two) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29)) ^ np.uint64(zlib.crc32(lang.encode()) << 8) ^ fan


def maybe_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the Bloom filter of ``filter_words`` may hold."""
    at, mask = np.arange(len(hashes)), np.uint64(64 * len(words) - 1)
    for k in range(PROBES):
        bit = hashes[at] >> np.uint64(8 * k) & mask
        at = at[words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1]
    out = np.zeros(len(hashes), bool)
    out[at] = True
    return out


def count_phrases(docs: DataFrame, sizes: tuple[int, ...], pairs: np.ndarray | None = None, held: int = HELD, words: int = WORDS) -> DataFrame:
    """lang, prefix, phrase, f: occurrences of every phrase of ``sizes`` words (at most 3).

    With 1 among the sizes the empty phrase counts all words of a language. pairs: as in ``PhraseCounter``.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = PhraseCounter(sizes, shared.value, held, words), defaultdict(int)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                found = tokens(b"\n".join(texts))
                if 1 in sizes:
                    totals[lang] += len(found) - found.count(b"") - found.count(b"\n")
                counter.add(lang, found)
                if counter.full():
                    yield from counter.spill(False)
        yield from counter.spill(True)
        if totals:
            yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int64()), pa.array([""] * len(totals)), pa.array(list(totals.values()), pa.int64())], schema=RUN)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    runs = texts.mapInArrow(run, "lang string, prefix long, phrase string, n long")
    return runs.repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, most: int, least: int, held: int = HELD, words: int = WORDS) -> DataFrame:
    """lang, phrase, f of phrases of up to most words with f of at least least; the empty phrase counts all words."""
    enough = (F.col("f") >= least) | (F.col("phrase") == "")
    short = settle(count_phrases(docs, (1, 2), None, held, words).where(enough), "pairs")
    if most == 2:
        return short.drop("prefix")
    pairs = filter_words(short.where(F.contains("phrase", F.lit(" "))).select(F.col("prefix").alias("seed")), PAIR_BITS)
    return settle(short.unionByName(count_phrases(docs, (3,), pairs, held, words).where(enough)).drop("prefix"), "phrases")


def scored(kept: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of two words or more; kept: lang, phrase, f with every part of every phrase.

    A cut after k words has floor(10^6 a^2 / (l r)); the least one counts, then the least k.
    """
    found = kept.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    place = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = found.where(F.size("words") > 1).select("lang", "phrase", F.col("f").alias("a"), "words", place.alias("k"))
    left = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(kept.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    whole = "cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))"
    cut = F.expr(f"({whole}) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    least = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(cut.alias("score"), "k", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def maximal(found: DataFrame, percent: int = 50) -> DataFrame:
    """found (lang, phrase, a) without phrases inside a longer one that is met at least percent as often."""
    words = F.split("phrase", " ")
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = found.select("lang", words.alias("words"), F.col("a").alias("over")).where(size > 2)
    inside = longer.select("lang", "over", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return found.join(inside, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("a"))).drop("over")


def top_of_each(rows: DataFrame, group: str, order: list[Column], tie: str, limit: int, ranked: int = RANKED) -> DataFrame:
    """The first limit rows of each group with rank, by rounds in which a task ranks about ``ranked`` rows of a group."""
    while True:
        shares = rows.count() // ranked + 1
        share = F.pmod(F.xxhash64(tie), F.lit(shares)).cast("int") if shares > 1 else F.lit(0)
        window = Window.partitionBy(group, "share").orderBy(*order)
        best = rows.withColumn("share", share).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit).drop("share")
        if shares == 1:
            return best
        rows = settle(best.drop("rank"), "best")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, percent: int = 50, limit: int = 2000, held: int = HELD, words: int = WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, then count, then phrase."""
    if not 2 <= most <= 3:
        raise ValueError("phrases have two or three words")
    kept = frequent_phrases(docs, most, least, held, words)
    found = settle(maximal(scored(kept), percent), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_of_each(found, "lang", order, "phrase", limit)
    totals = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
t as (select lang, id, unnest(w) as w, generate_subscripts(w, 1) as i from p),
s as (select lang, w, lead(w) over (partition by id order by i) as w2, lead(w, 2) over (partition by id order by i) as w3 from t),
g as (select lang, w as phrase, 1 as size from s union all select lang, w || ' ' || w2, 2 from s where w2 is not null union all select lang, w || ' ' || w2 || ' ' || w3, 3 from s where w3 is not null),
f as materialized (select lang, phrase, size, count(*) as f from g group by all having count(*) >= 10),
n as (select lang, count(*) as n from t group by lang),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from f where size > 1),
x as (select c.*, l.f as l, r.f as r, cast((1000000::hugeint * a * a) // (l.f::hugeint * r.f) as bigint) as score from c
  join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(w[k+1:], ' ')),
y as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, phrase, max(a) as over_ from (select lang, array_to_string(w[1:2], ' ') as phrase, a from y where size = 3 union all select lang, array_to_string(w[2:3], ' '), a from y where size = 3) group by all),
z as (select y.* from y left join o on o.lang = y.lang and o.phrase = y.phrase where over_ is null or 100 * over_ < 50 * a),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select k.lang, rank, phrase, a, l, r, n, score from k join n on n.lang = k.lang where rank <= 2000"""
