"""Dictionary records as nested JSON against a plain build of the same trees; vectors encoded once each."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweft.functions.lexicon import ENTRY_KEYS, LINKAGES, PRINTABLE
from wordweft.functions.scalars import pool_normalize
from wordweft.operators import dictionary, embed
from wordweft.sources import io

GLOSSES = {"a": ["one"], "b": ["one", "two words"], "c": ["one", "two words", "three"], "d": ["four"], "e": ["lone", "deep", "deeper"]}


def linked(*words):
    return [{"word": w} for w in words]


RAW = [
    {"word": "Oak", "pos": "noun", "categories": [{"kind": "x", "name": "Trees"}, {"kind": "y"}], "derived": [], "senses": [
        {"glosses": GLOSSES["a"], "synonyms": linked("tree")},
        {"glosses": GLOSSES["b"], "synonyms": linked("tree", "wood's end"), "examples": [{"text": 'An "oak", été.'}, {"ref": "no text"}]},
        {"glosses": GLOSSES["c"], "related": []}, {"glosses": GLOSSES["d"]}, {"glosses": GLOSSES["b"]}, {"glosses": GLOSSES["c"]},
    ]},
    {"word": "oak", "pos": None, "senses": [{"glosses": GLOSSES["e"]}, {"glosses": None, "synonyms": linked("x")}]},
    {"word": "empty", "pos": "verb", "senses": [], "synonyms": linked("void")},
    {"word": "gone", "pos": "noun", "senses": [{"glosses": []}]},
    {"word": "Gone", "pos": "noun", "senses": [{"glosses": ["good"]}]},
    {"word": None, "pos": "noun", "senses": [{"glosses": ["good"]}]},
]


def rich(text):
    return [t["s"] if t["w"] is None else {k: t[k] for k in "wlp"} for t in dictionary.rule_tokenizer(text, {})]


def items(values, key):
    return [{PRINTABLE[key]: rich(v)} if v is not None else {} for v in values]


def plain_tree(senses):
    """Children hang on the last sense that was one level up; what the parent says isn't said again."""
    tops, seen = [], {}
    for sense in senses:
        depth = len(sense["glosses"]) if sense["glosses"] is not None else 1
        above = seen.get(depth - 1)
        fields = {}
        for key in [*LINKAGES, "examples"]:
            if sense.get(key) is None:
                continue
            values = [v.get(PRINTABLE[key]) for v in sense[key]]
            held = above[1].get(key) if above else None
            if held is None:
                fields[key] = items(values, key)
            elif values[len(held) :]:
                fields[key] = items(values[len(held) :], key)
        if sense["glosses"] is not None:
            fields["glosses"] = rich(" ".join(sense["glosses"][len(above[1]["glosses"] or []) if above else 0 :]))
        node = {"children": [], "lexicalFields": fields}
        (above[0]["children"] if above else tops).append(node)
        seen[depth] = (node, sense)
    return tops


def plain_records():
    out = {}
    for e in RAW:
        if e["word"] is None or e["word"].lower() == "gone":
            continue
        entry = {"pos": e["pos"]} if e["pos"] is not None else {}
        entry["senses"] = plain_tree(e["senses"])
        entry |= {k: items([v.get(PRINTABLE[k]) for v in e[k]], k) for k in ENTRY_KEYS if e.get(k) is not None}
        out.setdefault(e["word"].lower(), []).append(entry)
    return out


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "entries.jsonl"
    path.write_text("\n".join(json.dumps(e) for e in RAW))
    return io.read_raw_entries(spark, f"file://{path}")


def stored_tokens(value, key=None):
    """(key, w, l, p) of every token below a lexical key."""
    if isinstance(value, list):
        return {t for v in value for t in stored_tokens(v, key)}
    if not isinstance(value, dict):
        return set()
    if {"w", "l", "p"} <= set(value):
        return {(key, value["w"], value["l"], value["p"])} if key else set()
    return {t for k, v in value.items() for t in stored_tokens(v, k if k in [*ENTRY_KEYS, "examples", "glosses"] else key)}


def test_records_are_nested_trees(spark, raw, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    assert dictionary.seed_dictionary(raw, path, min_rows=2)
    records, links = io.read_dictionary(spark, path)
    wanted = plain_records()
    got = {r["word"]: json.loads(r["lexical_entries"]) for r in records.collect()}
    assert got == wanted and records.count() == len(wanted)
    index = {r["word"]: r["all_links"] for r in links.collect()}
    for word, entries in wanted.items():
        sides = {("w", k, p, w) for k, w, _, p in stored_tokens(entries)} | {("l", k, p, low) for k, _, low, p in stored_tokens(entries)}
        assert {(f, k, p, t) for f, m in index[word].items() for k, tags in m.items() for p, targets in tags.items() for t in targets} == sides
    fields = {r["word"]: r["fields"] for r in dictionary.entry_fields(records).collect()}
    assert fields == {"oak": ["derived", "categories"], "empty": ["synonyms"]}


def test_a_full_dictionary_is_left_alone(spark, raw, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    io.write_dictionary(dictionary.dictionary_records(raw).where("word = 'oak'"), spark.createDataFrame([], "word string, all_links map<string,map<string,map<string,array<string>>>>"), path)
    assert not dictionary.seed_dictionary(raw, path, min_rows=1) and io.read_dictionary(spark, path)[0].count() == 1
    assert io.read_dictionary(spark, path)[1].first()["all_links"] == {}
    assert dictionary.seed_dictionary(raw, path, min_rows=2) and io.read_dictionary(spark, path)[0].count() == 2


def test_a_stored_row_is_one_entry(spark, raw, tmp_path):
    """However many entries a word has: records of a whole word, as they were stored, grow with their number."""
    many = raw.where("word = 'Oak' or word = 'oak'").crossJoin(spark.range(40)).withColumn("ord", F.col("ord") + 100 * F.col("id")).drop("id")
    path = f"file://{tmp_path}/entries"
    assert dictionary.seed_entries(many, path) and not dictionary.seed_entries(many, path)
    stored = io.read_entries(spark, path)
    rows = stored.collect()
    per_word = len(plain_records()["oak"])
    assert sorted(r["entry_ix"] for r in rows) == list(range(40 * per_word)) and {r["word"] for r in rows} == {"oak"}
    wanted = {json.dumps(e, sort_keys=True) for e in plain_records()["oak"]}
    assert {json.dumps(json.loads(r["entry"]), sort_keys=True) for r in rows} == wanted
    assert max(len(r["entry"]) for r in rows) <= max(len(json.dumps(e)) for e in plain_records()["oak"])
    flat = {(r["link_field"], r["lexical_key"], r["pos"], t) for r in dictionary.entry_links(stored).collect() for t in r["targets"]}
    whole = dictionary.record_links(dictionary.dictionary_records(many)).first()["all_links"]
    assert flat == {(f, k, p, t) for f, m in whole.items() for k, tags in m.items() for p, targets in tags.items() for t in targets}
    assert [(r["word"], r["fields"]) for r in dictionary.fields_of_entries(stored).collect()] == [("oak", ["derived", "categories"])]


def test_an_empty_dictionary(spark, raw, tmp_path):
    path = f"file://{tmp_path}/none"
    assert dictionary.seed_dictionary(raw.limit(0), path) and io.read_dictionary(spark, path)[0].isEmpty()


def test_keys_must_be_lower_case(spark, tmp_path):
    spark.createDataFrame([("Oak", "[]", "{}")], "word string, lexical_entries string, all_links string").write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="not lower case"):
        io.read_dictionary(spark, f"file://{tmp_path}/bad")[0].collect()


def encoder():
    def encode(words):
        width = max(map(len, words)) + 1
        at = np.array([[ord(c) for c in w.ljust(width, "\0")] for w in words])
        return np.stack([at, at % 5, at * 0 + 2], axis=-1), at > 0

    return encode


@pytest.mark.parametrize("pooling", ["mean", "cls"])
def test_vectors_are_pooled_as_by_columns(spark, pooling):
    words = spark.createDataFrame([(w,) for w in ("a", "bee", "abcdefgh", "zz", "q" * 300)], "word string")
    got = {r["word"]: r["embedding"] for r in embed.embed_words(words, encoder, pooling, batch_size=2).collect()}
    vectors, mask = encoder()(sorted(got))
    rows = [(w, v.tolist(), m.tolist()) for w, v, m in zip(sorted(got), vectors.astype(float), mask.astype(int))]
    table = spark.createDataFrame(rows, "word string, v array<array<double>>, m array<int>")
    for r in table.select("word", pool_normalize(F.col("v"), F.col("m"), pooling).alias("x")).collect():
        assert np.allclose(r["x"], got[r["word"]], atol=1e-6) and np.linalg.norm(got[r["word"]]) == pytest.approx(1)


def test_words_are_encoded_once(spark, tmp_path):
    path, seen = f"file://{tmp_path}/vectors", spark.sparkContext.accumulator(0)

    def counting():
        inner = encoder()

        def encode(words):
            seen.add(len(words))
            return inner(words)

        return encode

    words = spark.createDataFrame([("a",), ("b",), ("two words",), ("b",)], "word string")
    assert embed.seed_embeddings(words, path, counting) == 2 and seen.value == 2
    assert embed.seed_embeddings(words.unionByName(words.limit(0)), path, counting) == 0 and seen.value == 2
    more = spark.createDataFrame([("a",), ("c",)], "word string")
    assert embed.seed_embeddings(more, path, counting) == 1 and seen.value == 3
    assert {(r["word"], r["batch"]) for r in embed.stored_embeddings(spark, path).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert embed.seed_embeddings(more, path, counting, truncate=True) == 2
    assert {(r["word"], r["batch"]) for r in embed.stored_embeddings(spark, path).collect()} == {("a", 1), ("c", 1)}
    with pytest.raises(ValueError):
        embed.embed_words(words, encoder, "max")
