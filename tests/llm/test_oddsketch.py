"""Odd sketches and bands against all pairs of whole sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from wordweft.llm import oddsketch, queries
from wordweft.llm.jaccard import shingle_set

SCHEMA = "doc_id long, text string"


def brute(rows, percent=85):
    """(doc_id, n, component, kept) rows by comparing all distinct sets."""
    sets = {}
    for _, text in rows:
        s = frozenset(shingle_set((text or "").encode(), 5).tolist())
        sets.setdefault(s, len(sets))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [s for s in sets if s]
    by_hash = {}
    for s in keys:
        for h in s:
            by_hash.setdefault(h, []).append(s)
    for s in keys:
        for t in {t for h in s for t in by_hash[h] if sets[t] < sets[s]}:
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                parent[root(sets[s])] = root(sets[t])
    low = {}
    owner = [frozenset(shingle_set((text or "").encode(), 5).tolist()) for _, text in rows]
    for (doc, _), s in zip(rows, owner):
        if s and doc is not None:
            r = root(sets[s])
            low[r] = min(low.get(r, doc), doc)
    out = []
    for (doc, _), s in zip(rows, owner):
        component = low.get(root(sets[s])) if s else doc
        out.append((doc, len(s), component, doc == component))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def words(rng, n, stock=4000):
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


def family(rng, n, copies, edits):
    base = words(rng, n)
    out = [base]
    for _ in range(copies):
        new = list(base)
        for _ in range(rng.randrange(edits + 1)):
            new[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(new)
    return [" ".join(x) for x in out]


def test_components_of_families_and_odd_rows(spark):
    rng = random.Random(5)
    texts = family(rng, 150, 120, 9) + family(rng, 40, 60, 3) + family(rng, 1500, 12, 40) + [" ".join(words(rng, 80)) for _ in range(60)]
    # A shared head that makes no pair similar, and a chain each link of which is just similar enough.
    head = words(rng, 60)
    texts += [" ".join(head + words(rng, 45)) for _ in range(80)]
    chain = words(rng, 400)
    texts += [" ".join(chain[k * 9 : k * 9 + 200]) for k in range(15)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "A b c d e", "Ä b c d e", "ä b c d e"] * 2
    texts.append("long " * 20_000 + " ".join(words(rng, 20_000, 10**9)))
    rows = [(rng.choice([None, *range(300)]) if k % 17 == 0 else k, t) for k, t in enumerate(texts)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("x")).withColumn("n", F.lit(3)).withColumn("key", F.lit(1))
    assert as_rows(oddsketch.near_copies(df.repartition(5))) == brute(rows)


def test_empty_table(spark):
    assert oddsketch.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_bound_and_estimate():
    rng = np.random.default_rng(1)
    both = rng.integers(-(1 << 62), 1 << 62, 2000)
    for cut in (0, 100, 160, 400):
        a, b = np.sort(both[: 2000 - cut]), np.sort(both[cut:])
        whole = oddsketch.parity(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]).view(np.uint64), 2)
        assert np.bitwise_count((whole[0] ^ whole[1]).view(np.uint64)).sum() <= 2 * cut
        share = (oddsketch.min_samples(a) == oddsketch.min_samples(b)).mean()
        assert abs(share - (2000 - 2 * cut) / 2000) < 0.13


def test_bands_meet_above_the_threshold():
    """Of 300 pairs of sets at a similarity of 0.85 each shares a band and passes the samples' sketch."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        both = rng.integers(-(1 << 62), 1 << 62, 400)
        s = np.array([oddsketch.min_samples(np.sort(x)) for x in (both[:370], both[30:])])
        keys = oddsketch.band_keys(s)
        assert (keys[0] == keys[1]).any()


def test_op11_on_the_given_tables(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.op11_minhash_near_dedup(spark, path)) == brute(rows)
