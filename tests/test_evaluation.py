"""A suite of searches on vectors against plain searches, its summaries, resumption and cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_search import distances, model
from tests import test_search
from wordweft.functions.lexicon import ALL_FIELDS, ALL_POS
from wordweft.operators import embed, evalsuite, graph, search, training
from wordweft.sources.shared import settle

GLOSSES, ALL = 1 << 9, ALL_FIELDS


@pytest.fixture(scope="module")
def world(spark):
    """A graph with two kinds of links, vectors for most words, and a small model."""
    rng = random.Random(8)
    words = sorted(f"word{a}{b}" for a in "abcdef" for b in "ghijkl")
    edges = sorted({(rng.randrange(36), rng.randrange(36), rng.choice([1, 9])) for _ in range(130)})
    nodes = spark.createDataFrame(list(enumerate(words)), "node_id long, word string")
    table = spark.createDataFrame([(s, t, k, 0, "NOUN") for s, t, k in edges], "source_id long, target_id long, edge_type int, lemmatized int, target_pos string")
    gen = np.random.default_rng(3)
    vectors = {w: gen.normal(size=4).round(3).tolist() for w in words if w != words[5]}
    frame = spark.createDataFrame(list(vectors.items()), "word string, embedding array<double>")
    return words, edges, nodes, table, vectors, frame, training.fixed_weights(4 * 4 + 34)


def features(a, b, fields):
    a, b = np.array(a), np.array(b)
    cosine = a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12)
    bits = lambda m, n: [float(m >> k & 1) for k in range(n)]
    return np.concatenate([a, b, b - a, a * b, [cosine, np.linalg.norm(a - b), a @ b, 0.0], bits(fields, 12), bits(ALL_POS, 18)])


def test_suite_equals_single_searches(spark, world):
    words, edges, nodes, table, vectors, frame, weights = world
    near, learned = embed.EmbeddingHeuristic(frame), embed.LearnedHeuristic(frame, weights, 2.0)
    algorithms = [
        search.Algorithm("breadth/4", search.breadth_first(), batch_size=3, max_expansions=5), search.Algorithm("star/near", search.a_star(2), near, batch_size=3, max_expansions=5),
        search.Algorithm("exact/learned", search.a_star(1), learned, batch_size=3, max_expansions=5), search.Algorithm("greedy/beam", search.greedy(), near, queue_limit=5, batch_size=None, max_expansions=7),
    ]
    profiles = spark.createDataFrame([("glosses", 0, GLOSSES, ALL_POS), ("all", 0, ALL, ALL_POS)], "profile string, lemmatized int, field_mask int, pos_mask int")
    rng = random.Random(9)
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(5)] + [(words[0], words[5]), (words[1], words[1])]
    cases = spark.createDataFrame(pairs, "start_word string, target_word string")
    for mode in ("regular", "collide"):
        algorithms = algorithms if mode == "regular" else algorithms[:2]
        found = settle(evalsuite.evaluate_searches("screening", mode, cases, algorithms, profiles, nodes, table), "found")
        rows = found.collect()
        assert len(rows) == len(set(pairs)) * 2 * len(algorithms)
        reached = 0
        for r in rows:
            fields = GLOSSES if r["profile"] == "glosses" else ALL
            links = {}
            for s, t, k in edges:
                if fields >> k & 1:
                    links.setdefault(words[s], []).append((words[t], 1))
            a = next(x for x in algorithms if x.name == r["algorithm"])
            start, target = r["start_word"], r["target_word"]
            goals = [target] if mode == "regular" else [target, start]
            if a.heuristic and any(g not in vectors for g in goals):
                assert r["status"] == "error" and r["start_path"] is None and "no vector" in r["error"]
                continue
            h = {}
            for g in goals if a.heuristic else []:
                for w, v in vectors.items():
                    if a.heuristic is near:
                        x, y = np.array(v), np.array(vectors[g])
                        value = -(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-12)
                    else:
                        cost, logit = training.forward(features(v, vectors[g], fields)[None, :], weights)
                        value = max(cost[0], 0.0) + 2.0 / (1 + np.exp(logit[0]))
                    h[w, g] = 0.0 if w == g else float(value)
            want = model({w: sorted(ends) for w, ends in links.items()}, start, target, mode == "collide", a, h)
            assert (r["start_path"], r["target_path"], r["expansions"]) == (want[0], want[1], want[3]), r
            assert r["status"] == ("no_route" if want[0] is None else "success")
            if mode == "regular":
                exact = distances(links, target).get(start)
                assert r["exact_cost"] == exact and (r["combined_links"] is None or r["combined_links"] >= exact)
            reached += want[0] is not None
        assert reached >= 4
    done = found
    again = settle(evalsuite.evaluate_searches("screening", mode, cases, algorithms, profiles, nodes, table, done=done.where("not (profile = 'all' and algorithm = 'breadth/4' and start_word = target_word)").withColumn("rounds", F.lit(-1))), "again")
    assert {(r["profile"], r["rounds"] == -1) for r in again.select("profile", "rounds").distinct().collect()} >= {("glosses", True)} and again.where("profile = 'all' and rounds = -1").count() == 0
    assert again.count() == len(rows)
    total = evalsuite.summarize_results(done, "expansions").agg(F.sum("total"), F.sum("errors")).first()
    assert tuple(total) == (len(rows), sum(r["status"] == "error" for r in rows))


def test_searches_without_a_target_vector_fail(spark, world):
    words, _, nodes, table, _, frame, _ = world
    queries = spark.createDataFrame([(1, words[0], words[5], False, "x", 0, ALL, ALL_POS)], test_search.SEARCHES + ", lemmatized int, field_mask int, pos_mask int")
    with pytest.raises(Exception, match="no vector"):
        search.run_searches(queries, evalsuite.search_links(nodes, table), [search.Algorithm("x", search.greedy(), embed.EmbeddingHeuristic(frame))]).collect()


def test_cases_are_whole_or_an_error(spark, world):
    words, edges, nodes, table, *_ = world
    links = {}
    for s, t, _ in edges:
        links.setdefault(words[s], []).append((words[t], 1))
    # The pattern of case words takes letters only.
    got = evalsuite.generate_regular_cases(nodes, table, 5, 1).collect()
    assert len({(r["start_word"], r["target_word"]) for r in got}) == 5
    assert all(2 <= r["exact_cost"] < 8 and distances(links, r["target_word"])[r["start_word"]] == r["exact_cost"] for r in got)
    met = evalsuite.generate_collide_cases(nodes, table, 4, 1).collect()
    assert len({(r["start_word"], r["target_word"]) for r in met}) == 4
    for r in met:
        totals = [distances(links, w).get(r["start_word"], 99) + distances(links, w).get(r["target_word"], 99) for w in words]
        assert r["exact_cost"] == min(totals) and 2 <= min(totals) <= 8
    few = nodes.where("node_id < 2")
    for make in (evalsuite.generate_regular_cases, evalsuite.generate_collide_cases):
        with pytest.raises(ValueError):
            make(few, table.where("source_id < 2 and target_id < 2"), 5, 1, attempts=2)


def test_compact_edges_serve_all_searches_of_a_suite(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "node_id long, word string")
    edges = spark.createDataFrame([(0, 1, 9, 0, "NOUN"), (0, 1, 9, 0, "NOUN"), (1, 0, 3, 1, "VERB")], "source_id long, target_id long, edge_type int, lemmatized int, target_pos string")
    links = [sorted(map(tuple, evalsuite.search_links(nodes, e).collect())) for e in (edges, graph.compact_edges(edges))]
    assert links[0] == links[1] and len(links[0]) == 2
