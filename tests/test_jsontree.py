"""Tokens in nested JSON against a walk of the parsed objects."""

import json
import random

import pytest

from wordweft.operators import jsontree

KEYS = ["glosses", "examples"]


def walk(value, above, out):
    if isinstance(value, dict):
        if {"w", "l", "p"} <= value.keys() and value["p"] is not None:
            out.update((k, *(None if value[m] is None else str(value[m]) for m in ("p", "w", "l"))) for k in above)
        for k, v in value.items():
            walk(v, above | ({k} & set(KEYS)), out)
    elif isinstance(value, list):
        for v in value:
            walk(v, above, out)


def made(rng, depth):
    kind = rng.randrange(4) if depth else 3
    if kind == 0:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 1:
        return {rng.choice([*KEYS, "senses", "x y", "w"]): made(rng, depth - 1) for _ in range(3)}
    token = {"w": rng.choice(["Tree", None, "é"]), "l": "tree", "p": rng.choice(["NOUN", None])}
    if kind == 2:
        return {**token, rng.choice(KEYS): made(rng, depth - 1)}
    return rng.choice([token, token, "text", 3, None, {"w": "a", "l": "b"}])


def test_tokens_at_any_depth(spark):
    rng = random.Random(6)
    docs = [(k, json.dumps({"glosses": made(rng, rng.randrange(9))} if k % 3 else made(rng, 6))) for k in range(80)] + [(900, None), (901, "[]"), (902, "7")]
    want = set()
    for k, text in docs:
        out = set()
        walk(json.loads(text) if text else None, frozenset(), out)
        want |= {(k, *row) for row in out}
    got = [tuple(r) for r in jsontree.find_tokens(spark.createDataFrame(docs, "id long, json string"), KEYS).select("id", "lexical_key", "p", "w", "l").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_malformed_and_empty(spark):
    with pytest.raises(Exception):
        jsontree.find_tokens(spark.createDataFrame([(1, "{")], "id long, json string"), KEYS).collect()
    assert jsontree.find_tokens(spark.createDataFrame([], "id long, json string"), KEYS).columns == ["id", "lexical_key", "p", "w", "l"]
