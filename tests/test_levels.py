"""Levels with goals and merged tables, exact quantiles by counts, removal of settled tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordweft.functions.lexicon import ALL_FIELDS, ALL_POS
from wordweft.operators import graph, ranks
from wordweft.sources.shared import discard, settle


def _distances(links, root):
    found, front = {root: 0}, [root]
    while front:
        front = list(dict.fromkeys(t for s in front for t in links.get(s, ()) if t not in found and not found.update({t: found[s] + 1})))
    return found


def test_levels_with_goals_equal_a_plain_search(spark):
    rng = random.Random(3)
    # A chain longer than the levels that are merged at once, with some random arcs inside its first part.
    arcs = [(i, i + 1) for i in range(11)] + [(rng.randrange(6), rng.randrange(6)) for _ in range(6)] + [(20, 21)]
    links = {}
    for s, t in arcs:
        links.setdefault(s, set()).add(t)
    edges = settle(spark.createDataFrame([(s, t, 0, 9, 7) for s, t in set(arcs)], "source_id long, target_id long, lemmatized int, edge_type int, pos_id int"), "edges")
    roots = spark.createDataFrame([(r, r, 0, ALL_FIELDS, ALL_POS) for r in (0, 3, 20)], "query_id long, vertex long, lemmatized int, field_mask int, pos_mask int")
    every = {(r, v, d) for r in (0, 3, 20) for v, d in _distances(links, r).items()}
    assert {tuple(x) for x in graph.bfs(roots, edges).collect()} == every
    near = graph.bfs(roots, edges, max_depth=2).collect()
    assert {tuple(x) for x in near} == {x for x in every if x[2] <= 2}
    goals = spark.createDataFrame([(0, 11), (0, 0), (3, 4), (3, 21), (20, 20)], "query_id long, vertex long")
    asked = {(0, 11), (0, 0), (3, 4), (20, 20)}
    assert {tuple(x) for x in graph.bfs(roots, edges, goals=goals, only_goals=True).collect()} == {x for x in every if x[:2] in asked}
    # Met at once: the traversal of 20 goes no further, and one without goals does not start.
    some = graph.bfs(roots, edges, goals=goals.where("query_id = 20")).collect()
    assert {tuple(x) for x in some} == {(20, 20, 0), (0, 0, 0), (3, 3, 0)}


def test_quantiles_equal_numpy(spark):
    rng = random.Random(5)
    rows = [("even", float(rng.randrange(40))) for _ in range(301)] + [("hot", 2.0)] * 500 + [("hot", 9.5), ("one", -1.0), ("none", None), (None, 4.0), (None, 5.0)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(7)
    at = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = {r["k"]: r["q"] for r in ranks.quantiles(table, ["k"], "x", at).collect()}
    assert set(got) == {"even", "hot", "one", None}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([x for name, x in rows if name == k and x is not None], at).tolist())
    whole = ranks.quantiles(table, [], "x", at).first()["q"]
    assert whole == pytest.approx(np.quantile([x for _, x in rows if x is not None], at).tolist())
    assert ranks.quantiles(table.where("k = 'none'"), [], "x", at).first()["q"] == [None] * len(at)


def test_degrees_by_profile(spark):
    edges = spark.createDataFrame([(0, 1, 9, 0, "NOUN"), (0, 1, 9, 0, "DET"), (0, 2, 3, 0, "NOUN"), (5, 1, 9, 1, "NOUN")], "source_id long, target_id long, edge_type int, lemmatized int, target_pos string")
    from wordweft.operators import evalsuite

    got = {r["profile"]: (r["sources"], r["most"], r["median"]) for r in graph.profile_degrees(edges, evalsuite.profile_grid(spark)).collect()}
    assert got["raw__all-fields__all-pos"] == (1, 3, 3.0) and got["raw__glosses__collide-pos"] == (1, 1, 1.0) and got["lemma__glosses__all-pos"] == (1, 1, 1.0)


def test_settled_tables_can_be_removed(spark):
    table = settle(spark.range(3).withColumn("x", F.lit(1)), "short")
    folder = table.settled_at.removeprefix("file://")
    assert os.path.isdir(folder) and table.count() == 3
    discard(table, spark.range(2))
    assert not os.path.isdir(folder)


def test_parallel_edges_are_one_row_for_all_levels(spark):
    rng = random.Random(8)
    rows = {(rng.randrange(9), rng.randrange(9), rng.randrange(2), rng.randrange(12), rng.randrange(18)) for _ in range(400)}
    edges = spark.createDataFrame(sorted(rows), "source_id long, target_id long, lemmatized int, edge_type int, pos_id int")

    def asked(n):
        masks = [(k, rng.randrange(9), rng.randrange(2), rng.randrange(1, 1 << 12), 1 << rng.randrange(18) | 1 << rng.randrange(18)) for k in range(n)]
        return masks, spark.createDataFrame(masks, "query_id long, vertex long, lemmatized int, field_mask int, pos_mask int")

    def legal(mask):
        return {(s, t) for s, t, lem, key, pos in rows if lem == mask[2] and mask[3] >> key & 1 and mask[4] >> pos & 1}

    masks, roots = asked(5)
    pairs = {(r["source_id"], r["target_id"]): r["allowed"] for r in graph.legal_pairs(edges, roots).collect()}
    ordered = sorted({m[2:] for m in masks})
    assert pairs == {p: sum(1 << k for k, m in enumerate(ordered) if p in legal((0, 0, *m))) for p in set().union(*map(legal, masks))}
    # More settings than a row has bits go by their masks.
    for n in (5, graph.BLOCK + 3):
        masks, roots = asked(n)
        wanted = set()
        for m in masks:
            links = {}
            for s, t in legal(m):
                links.setdefault(s, set()).add(t)
            wanted |= {(m[0], v, d) for v, d in _distances(links, m[1]).items()}
        assert {tuple(x) for x in graph.bfs(roots, edges).collect()} == wanted
