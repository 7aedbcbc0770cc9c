"""Dictionary build, graph, search, races and training on hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordweft.functions import scalars
from wordweft.functions.lexicon import ALL_FIELDS, ALL_POS, LEXICAL_KEYS, POS_TAGS, field_mask
from wordweft.operators import dictionary, embed, evalsuite, graph, races, training
from wordweft.sources import io


def sense(glosses=None, **fields):
    return {"glosses": glosses, **{k: [{"word": w} for w in v] for k, v in fields.items()}}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    import json

    entries = [
        {"word": "Tree", "pos": "noun", "senses": [sense(["A"]), sense(["A", "B"]), sense(["A", "B", "C"]), sense(["D"]), sense(["D", "E"])], "synonyms": [{"word": "Big plant"}], "related": []},
        {"word": "tree", "pos": "verb", "senses": [sense(["A"], synonyms=["up"]), sense(["A", "B"], synonyms=["up", "down"]), sense(["D"]), sense(["D", "E", "F"])]},
        {"word": "bare", "pos": "noun", "senses": [sense(None), sense(["X", "Y"])]},
        {"word": "bad", "pos": "noun", "senses": [sense([])]},
        {"word": "Bad", "pos": "noun", "senses": [sense(["fine"])]},
        {"word": None, "pos": "noun", "senses": [sense(["fine"])]},
        {"word": "none", "pos": "noun"},
    ]
    path = tmp_path_factory.mktemp("raw") / "entries.jsonl"
    path.write_text("\n".join(json.dumps(e) for e in entries))
    return io.read_raw_entries(spark, f"file://{path}")


def test_gloss_tree_keeps_stale_parents(raw):
    rows = dictionary.gloss_tree(raw).collect()
    parents = lambda w, e: [r["parent_ix"] for r in sorted((r for r in rows if (r["word"], r["entry_ix"]) == (w, e)), key=lambda r: r["ix"])]
    glosses = lambda w, e: [r["gloss"] for r in sorted((r for r in rows if (r["word"], r["entry_ix"]) == (w, e)), key=lambda r: r["ix"])]
    assert parents("tree", 0) == [None, 0, 1, None, 3] and glosses("tree", 0) == ["A", "B", "C", "D", "E"]
    assert parents("tree", 1) == [None, 0, None, 1] and glosses("tree", 1) == ["A", "B", "D", "F"]
    assert parents("bare", 0) == [None, 0] and glosses("bare", 0) == [None, "X Y"]
    added = next(r["synonyms"] for r in rows if (r["word"], r["entry_ix"], r["ix"]) == ("tree", 1, 1))
    assert added == ["down"]


def test_bad_entries_take_their_word(raw):
    assert {(r["word"], r["reason"]) for r in dictionary.rejected_words(raw).collect()} == {("bad", "empty glosses"), (None, "null word"), ("none", "no senses")}
    built = dictionary.build_dictionary(raw)
    assert {r["word"] for r in built["words"].collect()} == {"tree", "bare"}
    targets = {(r["link_field"], r["lexical_key"], r["target"]) for r in built["links"].where("word = 'tree'").collect()}
    assert {("w", "synonyms", "Big"), ("l", "synonyms", "big"), ("w", "synonyms", "plant"), ("w", "glosses", "F")} <= targets
    assert "w" in dictionary.links_to_map(built["links"]).where("word = 'tree'").first()["all_links"]


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"word": "a"\n')
    with pytest.raises(Exception):
        io.read_raw_entries(spark, f"file://{tmp_path}/x.jsonl").collect()


def test_targets_are_lowered_before_they_are_made_distinct(spark):
    links = spark.createDataFrame([("source", "w", "glosses", "NOUN", t) for t in ("Having", "having", "Related")], "word string, link_field string, lexical_key string, pos string, target string")
    asked = spark.createDataFrame([("Source",), ("unknown",)], "word string")
    found = graph.links_for(asked, links, "w", ["glosses"], POS_TAGS).collect()
    assert [(r["word"], r["targets"]) for r in found] == [("source", ["having", "related"])]
    assert graph.links_for(asked, links, "l", ["glosses"], POS_TAGS).first()["targets"] == []


@pytest.fixture(scope="module")
def small(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    nodes = spark.createDataFrame(list(enumerate(names)), "node_id long, word string")
    pairs = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (5, 3), (0, 1)]
    edges = spark.createDataFrame([(s, t, 9, 0, "NOUN") for s, t in pairs], "source_id long, target_id long, edge_type int, lemmatized int, target_pos string")
    return nodes, edges


def ask(spark, *pairs, fields=ALL_FIELDS):
    return spark.createDataFrame([(i, s, t, 0, fields, ALL_POS) for i, (s, t) in enumerate(pairs)], "query_id long, start string, target string, lemmatized int, field_mask int, pos_mask int")


def test_exact_paths(spark, small):
    asked = ask(spark, ("A", "d"), ("d", "a"), ("zz", "zz"), ("zz", "a"))
    assert {r["query_id"]: (r["path"], r["links"]) for r in graph.shortest_paths(asked, *small).collect()} == {0: (["a", "e", "d"], 2), 1: (None, None), 2: (["zz"], 0), 3: (None, None)}
    none = graph.shortest_paths(ask(spark, ("a", "d"), fields=field_mask(["examples"])), *small).first()
    assert none["path"] is None


def test_collide_and_distances(spark, small):
    met = graph.collide_paths(ask(spark, ("a", "f"), ("b", "b")), *small).orderBy("query_id").collect()
    assert (met[0]["start_path"], met[0]["target_path"], met[0]["links"]) == (["a", "e", "d"], ["f", "d"], 3) and met[1]["links"] == 0
    words = spark.createDataFrame([("a",), ("d",), ("zz",)], "word string")
    table = {(r["start"], r["target"]): r["links"] for r in graph.distance_table(words, words, *small, 0).collect()}
    assert table[("a", "d")] == 2 and table[("a", "a")] == 0 and math.isinf(table[("d", "a")]) and math.isinf(table[("zz", "zz")])
    assert graph.distance_table(words, words, *small, 0, fields=0).where("start = 'zz' and target = 'zz'").first()["links"] == 0
    assert graph.out_neighbors(words, *small).where("word = 'a'").count() == 3


def test_race_labels_and_stats(spark):
    df = spark.createDataFrame([(None,), (1234,), (59999,), (61000,)], "ms long")
    assert [r[0] for r in df.select(scalars.step_time_label(F.col("ms"))).collect()] == ["Start", "1.2s", "59.9s", "1m 1s"]
    steps = spark.createDataFrame([(1, 1, "start", "a", 0, 1), (1, 1, "start", "b", 50, 2), (1, 1, "target", "b", 10, 3)], "game long, player long, side string, word string, ts_ms long, event_id long")
    row = races.race_table(steps).first()
    assert (row["found"], row["link_count"], row["duration_ms"]) == (True, 1, 50)
    assert races.race_aggregates(steps).first().asDict() == row.asDict()


def test_pair_samples_are_the_least_hashes(spark):
    pool = spark.range(3000).withColumnRenamed("id", "vertex")
    settings = training.sample_settings(spark, 4, 1)
    found = training.sample_pairs(pool, settings, 3, 5, 7)
    got = {(r["setting_id"], r["source"]) for r in found.select("setting_id", "source").distinct().collect()}
    least = Window.partitionBy("setting_id").orderBy(training.draw(7, "setting_id", "vertex"), "vertex")
    every = pool.join(settings.select("setting_id")).select("setting_id", "vertex", F.row_number().over(least).alias("k"))
    assert got == {(r["setting_id"], r["vertex"]) for r in every.where("k <= 3").collect()} and found.count() == 4 * 3 * 5
    assert training.sample_pairs(pool.limit(4), settings, 3, 5, 7).count() == 4 * 3 * 1


def test_training_helpers(spark):
    settings = training.sample_settings(spark, 50, 1).collect()
    assert all(r["field_mask"] > 0 and r["pos_mask"] > 0 for r in settings) and {r["lemmatized"] for r in settings} == {0, 1}
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 3 == 0, -1.0).otherwise(2.0))
    quota = training.balance_reachable(df, 100, 0.6, 1, ["id"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in quota} == {2.0: 60, -1.0: 40}
    least = [r["id"] for r in df.orderBy(training.draw(1, "id"), "id").limit(70).collect()]
    assert sorted(r["id"] for r in training.take_exact(df, 70, 1, ["id"]).collect()) == sorted(least)
    with pytest.raises(ValueError):
        training.take_exact(df, 1001, 1, ["id"])
    parts = {r["part"]: r["count"] for r in training.split(df, ["id"], 1).groupBy("part").count().collect()}
    assert sum(parts.values()) == 1000 and 740 < parts[0] < 860
    weights = training.init_weights(290, 1)
    x = np.random.default_rng(0).normal(size=(5, 290)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = [r["cost"] for r in training.score_cost(rows, weights).orderBy("id").collect()]
    assert np.allclose(got, training.forward(x, weights)[0], atol=1e-5)


def test_training_set_contract(spark, tmp_path):
    df = spark.range(3)
    io.save_training_set(df, f"file://{tmp_path}/t", "cost", 290)
    assert io.load_training_set(spark, f"file://{tmp_path}/t", "cost", 290).count() == 3
    with pytest.raises(ValueError):
        io.load_training_set(spark, f"file://{tmp_path}/t", "cost", 291)


def test_guarded_load_and_graph_contract(spark, small, tmp_path):
    path = f"file://{tmp_path}/g"
    assert io.load_if_short(spark.range(5), f"{path}/t", 5) and not io.load_if_short(spark.range(9), f"{path}/t", 5)
    io.write_graph(*small, f"{path}/ok")
    assert io.read_graph(spark, f"{path}/ok")[1].count() == 7
    io.write_graph(small[0], small[1].withColumn("target_pos", F.lit("ODD")), f"{path}/bad")
    with pytest.raises(ValueError):
        io.read_graph(spark, f"{path}/bad")


def test_profiles_and_vectors(spark):
    assert {r["profile"] for r in evalsuite.profile_grid(spark).collect()} >= {"lemma__glosses__all-pos", "raw__all-fields__collide-pos"}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, embedding array<double>")
    asked = spark.createDataFrame([("a", "b"), ("b", "b"), ("z", "b")], "word string, target string")
    h = {r["word"]: r["h"] for r in embed.embedding_heuristic(asked, vectors).collect()}
    assert h["a"] == pytest.approx(0) and h["b"] == 0 and math.isinf(h["z"])
    assert len(LEXICAL_KEYS) == 12 and len(POS_TAGS) == 18


def test_stream_equals_batch(spark, tmp_path):
    from wordweft.plans import analytics

    ts = "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 7 % 50)"
    events = spark.range(200).selectExpr("id as event_id", f"{ts} as ts", "id % 30 as user_id", "concat('t', id % 3) as event_type", "cast(id as double) as value", "'{}' as props")
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    stream = analytics.live_race_state(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, stream)) == sorted(map(tuple, analytics.race_stats(spark, f"file://{tmp_path}").collect()))
