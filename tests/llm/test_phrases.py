"""Collocations against a plain count of the contract, with tries that spill and number anew all the time."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wordweft.llm import phrases, queries

SCHEMA = "lang string, text string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, limit=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for size in (1, 2, 3):
                counts.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    out = []
    for lang in {x for x, _ in found}:
        mine = {p: v for (x, p), v in found.items() if x == lang}
        kept = [p for p, v in mine.items() if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * u[1] >= 50 * v[1] for q, u in mine.items())]
        kept.sort(key=lambda p: (-mine[p][0], -mine[p][1], " ".join(p).encode()))
        out += [(lang, k + 1, " ".join(p), *mine[p][1:], totals[lang], mine[p][0]) for k, p in enumerate(kept[:limit])]
    return sorted(out)


def as_rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stock = ["New", "york", "É", "é", "of", "the", "a\x00b", "x" * 300, "don't", "日本", *[f"w{k}" for k in range(6)]]
    out = []
    for k in range(1200):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(stock[:8] + stock) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "\x0b", " "])
        out.append((rng.choice(["en", "en", "de", None, ""]), text))
    out += [("en", None), ("en", ""), ("xx", "rare words only"), ("rep", "go go go go go go go go go go go go go")]
    return out + out[:50] + [("en", "to be or " * 30_000)]


def test_collocations_follow_the_contract(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("prefix", F.lit("x"))
    want = brute(rows)
    assert len(want) > 50
    assert as_rows(phrases.collocations(df.repartition(6))) == want
    assert as_rows(phrases.collocations(df.coalesce(1), held=40, words=12)) == want
    # A limit and ranking in rounds.
    assert as_rows(phrases.collocations(df, limit=7)) == brute(rows, limit=7)


def test_ranking_in_rounds(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("lang"), F.xxhash64("id").alias("score"), F.col("id").cast("string").alias("phrase"))
    order = [F.desc("score"), F.asc("phrase")]
    one, many = [phrases.top_of_each(df, "lang", order, "phrase", 11, ranked=r) for r in (1 << 20, 100)]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(*one.columns).collect()))


def test_a_full_filter_lets_everything_through(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "filter_words", lambda seeds, bits: __import__("numpy").full(4, -1, "int64").view("uint64"))
    assert as_rows(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_crowded_containers_burst(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 3)
    counter = phrases.PhraseCounter((1, 2, 3))
    text = " ".join(f"a b{k % 7} c{k % 5}" for k in range(200)).encode()
    counter.add("en", phrases.tokens(text))
    counter.add("en", phrases.tokens(text))
    assert counter.tries["en"].burst
    batches = [b for b in counter.spill(True)]
    found = {p: n for b in batches for p, n in zip(b["phrase"].to_pylist(), b["n"].to_pylist())}
    words = text.decode().split()
    want = Counter(" ".join(words[i : i + s]) for s in (1, 2, 3) for i in range(len(words) - s + 1))
    assert found == {p: 2 * n for p, n in want.items()}
    ordered = [p.split(" ") for b in batches for p in b["phrase"].to_pylist()]
    assert ordered == sorted(ordered)


def test_products_beyond_64_bits(spark):
    a, l, r = 3 * 10**12 + 7, 5 * 10**12 + 1, 7 * 10**12 + 3
    kept = spark.createDataFrame([("en", "", 10**14), ("en", "x", l), ("en", "y", r), ("en", "x y", a)], "lang string, phrase string, f long")
    assert phrases.scored(kept).first()["score"] == 10**6 * a * a // (l * r)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op13_has_the_rows_of_its_sql(spark):
    path = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{path}/documents.parquet'")
    want = duckdb.sql(f"select {', '.join(COLUMNS)} from ({phrases.ORACLE})").fetchall()
    assert as_rows(queries.op13_phrases(spark, path)) == sorted(want)
