"""Corpus operators against brute force on small fixtures with nulls, empties, repeats and clashing columns."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wordweft.llm import bpe, cnn, common, dac, jaccard, langid, lbl, oddsketch, rules, sharding, simhash, tiling, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("the", "of", "un", "mo", "ka", "be") for b in ("ra", "ti", "n", "lo", "", "ss")]
    base = [words(rng, rng.randrange(12, 120), vocab) + "." for _ in range(40)]
    near = [t.replace(" ", " X ", 1) for t in base[:5]]
    odd = [None, "", "   \n\t ", "one two", "x" * 300, "don't  you\n\nsee  ", "ünï 漢字 🙂 <|endoftext|>", "A B A B A B A B A B A B A B", words(rng, 4000, vocab)]
    return base + near + base[:3] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- SimHash -----------------------------------------------------------------


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_matches_brute_force(docs, texts):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [found[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [found[i]["component_id"] for i in range(len(texts))] == slow_components(fps, range(len(texts)), 4)


def test_crowded_cells_keep_components(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (4, 4096):
        roots = {r["node"]: r["root"] for r in common.components(simhash.links(df, hot_cell=hot)).collect()}
        mine = [roots.get(f, f) for f in signed]
        assert mine == slow_components(fps, signed, 4), hot


def test_cells_are_counted_one_by_one_only_in_crowded_classes(spark, monkeypatch):
    made, settle = [], simhash.settle

    def noted(df, name):
        made.append(name)
        return settle(df, name)

    monkeypatch.setattr(simhash, "settle", noted)
    rng = random.Random(6)
    apart = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    near = [x ^ 5 for x in apart[::10]]
    df = spark.createDataFrame([(x,) for x in apart + near], "fp long")
    slow = {(min(x, x ^ 5), max(x, x ^ 5)) for x in apart[::10]}
    assert {(r["a"], r["b"]) for r in simhash.links(df).collect()} == slow and made == ["full_classes"]
    crowd = spark.createDataFrame([(x,) for x in apart + near + [apart[0] ^ (1 << k) for k in range(8)]], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(crowd, hot_cell=8)).collect()}
    assert "hot_cells" in made and len({roots[apart[0] ^ (1 << k)] for k in range(8)} | {roots[apart[0]], roots[near[0]]}) == 1


def workers_of_a_task(df):
    """The most Python operators that one task of the plan runs, one upon the other."""
    path, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" :+-*(0123456789)")
        path[:] = [x for x in path if x[0] < len(line) - len(name.lstrip())] + [(len(line) - len(name.lstrip()), name)]
        own = [n for _, n in path]
        own = own[max((k for k, n in enumerate(own) if n.startswith("Exchange")), default=-1) + 1 :]
        most = max(most, sum(n.startswith(("ArrowEvalPython", "MapInArrow")) for n in own))
    return most


def test_a_task_of_near_copies_runs_one_python_worker(spark, monkeypatch):
    seen, settle = {}, simhash.settle

    def noted(df, name):
        seen[name] = max(seen.get(name, 0), workers_of_a_task(df))
        return settle(df, name)

    monkeypatch.setattr(simhash, "settle", noted)
    monkeypatch.setattr(oddsketch, "settle", noted)
    rows = family(random.Random(4))
    simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert seen["parts"] == seen["cells"] == 1


def test_keep_one_keeps_columns_and_one_row_each(docs, texts):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and not {45, 46, 47} & set(ids)


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def family(rng):
    """Texts of twenty families, each with copies that differ in one word to a fourth of the words."""
    vocab = [f"v{i}" for i in range(3000)]
    out = ["notice of the shared licence terms that every text carries " + words(rng, rng.randrange(20, 150), vocab) for _ in range(20)]
    for t in out[:20]:
        for changes in (1, 1, 2, 3, 5, 9):
            w = t.split()
            for i in rng.sample(range(len(w)), changes):
                w[i] = rng.choice(vocab)
            out.append(" ".join(w))
    return out + ["", None, "a b", "A  b"]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    found = family(random.Random(11))
    sets = [slow_set(t) for t in found]
    root = list(range(len(found)))
    alike = [(j, i) for i in range(len(found)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in root:
        for j, i in alike:
            root[i] = root[j] = min(root[i], root[j])
    far = sum((simhash.fingerprint((found[i] or "").encode()) ^ simhash.fingerprint((found[j] or "").encode())).bit_count() > 4 for j, i in alike)
    assert far > 10 and 22 < len(set(root)) < len(found) - 10
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    for often in (2, 16):
        monkeypatch.setattr(jaccard, "FREQUENT_IN", often)
        assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted({*root})


def test_one_row_stays_of_each_component_whatever_the_ids(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    t = [words(rng, 60, vocab) for _ in range(6)]
    near = t[0] + " more"
    rows = [(None, t[0]), (None, near), (None, t[1]), (None, t[2]), (5, t[2]), (7, t[3]), (7, t[4]), (8, t[4]), (9, t[5]), (9, t[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    first = next(x for _, x in got if x in (t[0], near))
    assert Counter(got) == Counter([(None, first), (None, t[1]), (5, t[2]), (7, t[3]), (7, t[4]), (9, t[5])])


def test_copies_meet_by_fingerprints_and_stars(spark, monkeypatch):
    """The grid of fingerprints takes part, and a family of near copies is never paired out."""
    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(3000)]
    base = words(rng, 150, vocab).split()
    found = [" ".join(w if k != i else "changed" for k, w in enumerate(base[: 149 - j])) for i in range(100) for j in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    asked, sizes, folder = [], {}, spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/tables"
    grid, before = simhash.links, {*os.listdir(folder)} if os.path.isdir(folder) else set()
    monkeypatch.setattr(simhash, "links", lambda fps, *rest: asked.append(fps.count()) or grid(fps, *rest))
    assert [r["doc_id"] for r in simhash.keep_one(df).collect()] == [0]
    for at in {*os.listdir(folder)} - before:
        for name in os.listdir(f"{folder}/{at}"):
            sizes[name] = max(sizes.get(name, 0), spark.read.parquet(f"file://{folder}/{at}/{name}").count())
    assert asked and 10 < asked[0] <= len(found)
    assert {"pairs", "links"} <= {*sizes}
    assert max(sizes.get(name, 0) for name in ("pairs", "candidates", "links", "open_pairs")) <= 4 * len(found)


def test_long_near_copies_equal_brute_force(spark):
    """Sets that are cut into parts, of sizes about the classes' limits and similarities about the threshold."""
    rng = random.Random(14)
    vocab = [f"v{i}" for i in range(50000)]
    head = words(rng, 200, vocab)
    found = []
    for n in (850, 1000, 1250, 1700, 2400, 4300):
        base = words(rng, n, vocab).split()
        found.append(head + " " + " ".join(base))
        for share in (0.75, 0.79, 0.83, 0.9):
            found.append(head + " " + " ".join(base[: int(share * len(base))]))
        found.append(head + " " + " ".join(w if k % 60 else "changed" for k, w in enumerate(base)))
    rng.shuffle(found)
    sets, root = [slow_set(t) for t in found], [*range(len(found))]
    assert len({*map(frozenset, sets)}) == len(found) and max(map(len, sets)) > 4200
    alike = [(j, i) for i in root for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in range(len(found)):
        for j, i in alike:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted({*root})
    assert 6 <= len({*root}) < len(found) - 6


# --- sharding ----------------------------------------------------------------


def test_shards_hold_every_row_once(docs, texts):
    rows = sharding.shard(docs.withColumnRenamed("source", "size"), shards=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16
    for k in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in by_text.values()) <= 1


def test_shards_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "same" * 5 if i % 3 == 0 else f"text {i} " * (i % 7 + 1)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 200


def test_equal_rows_are_parted_between_shards(spark):
    rows = [(None, "same words again " * 3)] * 4000 + [(i, f"text {i} of its own") for i in range(4000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, `a.b` string, key int").repartition(5)
    found = sharding.shard(df, shards=8, range_bytes=20_000)
    assert found.columns == ["doc_id", "text", "a.b", "key", "size", "law", "shard", "slot", "grown_shard"]
    got = found.collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 8000 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8 + 200
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)


def test_shards_of_nothing_and_of_one_long_text(spark, tmp_path):
    assert sharding.shard(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "x" * 2_000_000), (1, None), (2, "")], "doc_id long, text string")
    sharding.write_shards(df, f"file://{tmp_path}/shards", 3)
    got = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert sorted(r["size"] for r in got) == [16, 16, 2_000_016] and all(r["law"] == "bytes" for r in got)


# --- rules -------------------------------------------------------------------


def slow_counts(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_and_verdict(docs, texts):
    for r in rules.judge(docs).collect():
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts == slow_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r["kept"] == (r["first_rule"] is None) and not (r["base_failed"] and r["kept"])


def test_rules_keep_same_rows_in_any_order(docs):
    a = {r["doc_id"] for r in rules.keep(docs).collect()}
    b = {r["doc_id"] for r in rules.keep(docs, rules=tuple(reversed(rules.RULES))).collect()}
    assert a == b == {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
    assert rules.keep(docs.limit(0)).count() == 0


def test_rules_stay_native(docs):
    plan = rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- language model ----------------------------------------------------------


def test_language_model_counts_and_base_score(docs, texts):
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split() + [" end"]
    counts = Counter(w for t in train for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    for frequent in (10, 1 << 18):
        for r in lbl.score(docs, ~lbl.held_out(), frequent=frequent).collect():
            w = split(texts[r["doc_id"]])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
            assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    n, length = 30, 60_000
    words_ = [1, 2]
    for _ in range(length):
        x = rng.random()
        words_.append((words_[-1] + 1) % n if x < 0.4 else (words_[-2] + 7) % n if x < 0.8 else int(rng.integers(n)))
    w = np.array(words_)
    triples = np.stack([w[:-2], w[1:-1], w[2:]], axis=1)
    frequency = np.bincount(w, minlength=n) / len(w)
    model = lbl.initial(frequency)
    sums = lbl.unseen(model)
    for k in range(3):
        lbl.train(model, sums, triples, frequency, k)
    table = np.stack([model.normalisers(c) for c in range(n)])
    scores = np.stack([model.contexts(np.full(n, c), np.arange(n)) @ model.represent.T + model.bias - table[c][:, None] for c in range(n)])
    assert np.allclose(np.exp(scores).sum(axis=2), 1, atol=1e-4)
    mean = scores[triples[:, 1], triples[:, 0], triples[:, 2]].mean()
    assert mean > (frequency * np.log(frequency)).sum() + 0.2


def slow_scores(texts, counts, ends, model, names):
    """log10 probabilities by definition, one token at a time with its own softmax."""
    own, first = {w: k + 1 for k, w in enumerate(names)}, 1 + len(names)
    inside = {}
    for w, c in counts.items():
        if w not in own:
            k = first + lbl.suffix(w)
            inside[k] = inside.get(k, 0) + c + 1
    out = []
    for t in texts:
        found, before = 0.0, (lbl.END, lbl.END)
        for w in [*(t or "").encode().lower().split(), None]:
            kind = lbl.END if w is None else own.get(w) or first + lbl.suffix(w)
            scores = ((model.represent[before[1]] @ model.near + model.represent[before[0]] @ model.far) @ model.represent.T + model.bias).astype(float)
            found += (scores[kind] - np.log(np.exp(scores).sum())) / np.log(10)
            if w is not None and w not in own:
                found += np.log10((counts.get(w, 0) + 1) / (inside.get(kind, 0) + 1))
            before = (before[1], kind)
        out.append(found)
    return out


def test_language_model_scores_equal_slow_ones(docs, texts, monkeypatch):
    made = []
    fit = lbl.fit
    monkeypatch.setattr(lbl, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in (t or "").encode().lower().split())
    names = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    for frequent in (10, 1 << 18):
        got = {r["doc_id"]: r for r in lbl.score(docs, ~lbl.held_out(), frequent=frequent, own=20).collect()}
        want = slow_scores(texts, counts, len(train), made[-1], names)
        assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want, abs=2e-2, rel=1e-4)
        assert all(r["score"] > r["base_score"] - 2 * r["n_tokens"] for r in got.values())


def test_language_model_with_nulls_repeats_and_extra_columns(spark):
    rows = [(None, "a b", 1), (1, None, 2), (1, "a b", 3), (1, "a b", 3), (2, "", 4), (3, "x" * 50_000 + " y", 5), (4, "word " * 30_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in lbl.score(df, ~lbl.held_out()).collect())
    assert got == Counter([(None, 3), (1, 1), (1, 3), (1, 3), (2, 1), (3, 3), (4, 30_001)])
    assert lbl.score(df.limit(0), ~lbl.held_out()).count() == 0


def test_language_model_without_training_rows(spark):
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lbl.score(one, lbl.held_out() & lbl.held_out().isNull()).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)


# --- byte pairs --------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def tiktoken_of(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, texts, ranks):
    whole = tiktoken_of(ranks)
    odd = ["a\u00a0\u2003 b\x1c\x1fc\x85", "x\u3000 y \t\n  z", "it's IT'S we'll", "12\u0663\u00bd ٣٤", "e\u0301 \u200d\ufeff", "\0\0 \0", " ", "a" * 3000 + "=" * 200]
    rows = [(i, t) for i, t in enumerate(texts + odd)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")
    want = Counter()
    for i, t in rows:
        ids = whole.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    for frequent in (20, 1 << 20):
        assert Counter(tuple(r) for r in bpe.digests(df, ranks, public_tokenizers.PATTERN, frequent).collect()) == want
    coded = bpe.encode(df, ranks, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["text"]).decode()) for r in bpe.decode(coded, ranks).collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.digests(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_plans_hold_no_rank_map(spark, docs, ranks):
    """The driver writes out every plan of a query, several times, with the literals in it whole."""

    def nodes(plan):
        yield plan
        for k in range(plan.children().length()):
            yield from nodes(plan.children().apply(k))

    found = bpe.digests(docs, ranks, public_tokenizers.PATTERN)
    assert max(len(node.simpleString(25)) for node in nodes(found._jdf.queryExecution().sparkPlan())) < 1 << 16


def test_digests_of_the_pipeline_run_one_python_worker_a_task(spark, docs, ranks):
    import corpus_pipeline

    apart = corpus_pipeline.byte_bpe(spark, docs, "")
    assert workers_of_a_task(apart) == 1
    assert Counter(map(tuple, apart.collect())) == Counter(map(tuple, bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()))


def test_both_folds_give_the_library_s_merges(spark, ranks):
    rng = random.Random(9)
    some = [w.decode("utf-8", "ignore") for w in rng.sample(sorted(ranks), 400)]
    found = [a + b + c for a, b, c in zip(some, some[1:], some[2:])] + ["a", "é", "漢字" * 30, "ab" * 90, "a" * 777, " " * 150]
    found = [w for w in found if w]
    rank_map, whole, word = bpe.RankMap(ranks), tiktoken_of(ranks), F.col("word").cast("binary")
    both = common.bind(rank_map.literal, lambda t: F.struct(bpe.fold_pairs(word, rank_map, t).alias("pairs"), bpe.fold_candidates(word, rank_map, t).alias("runs")))
    df = spark.createDataFrame([(w,) for w in found], "word string").repartition(2)
    for r in df.select("word", both.alias("both")).select("word", "both.*").collect():
        want = whole._encode_single_piece(r["word"])
        assert r["runs"] == want and (r["pairs"] == want or len(r["word"].encode()) > bpe.SHORT), r["word"]


def test_ranks_that_do_not_follow_merges_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError, match="merges"):
        bpe.check_order(ranks)


# --- quality, language, toxicity ----------------------------------------------


def test_cnn_learns_marks_and_scores_whole_texts():
    rng = random.Random(2)
    vocab = ["theon", "ofra", "lost", "ent", "inga"]
    good = [words(rng, 40, vocab).encode() for _ in range(60)]
    bad = [words(rng, 40, [w + "***" for w in vocab]).encode() for _ in range(60)]
    model = cnn.fit(good[:50] + bad[:50], np.array([1] * 50 + [0] * 50))
    assert all(cnn.probability(t, model) > 0.7 for t in good[50:]) and all(cnn.probability(t, model) < 0.7 for t in bad[50:])
    long = good[0] * 400
    assert cnn.probability(long + bad[0] * 2000, model) < cnn.probability(long, model)
    assert 0 <= cnn.probability(None, model) <= 1 and cnn.probability(b"", model) == cnn.probability(None, model)


def test_cnn_without_labels():
    assert cnn.probability(b"text", cnn.fit([], np.zeros(0))) == pytest.approx(0.5)


def test_language_by_compression(spark):
    rng = random.Random(3)
    tongues = {"aa": ["thon", "erea", "inge", "atst", "whou"], "bb": ["schei", "ungen", "keit", "ichau", "pfer"]}
    rows = [(i, words(rng, 60, v), lang) for i, (lang, v) in enumerate(list(tongues.items()) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "Thon erea inge", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df.where(~langid.held_out()))).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert langid.identify(df, []).where("lang_pred <> 'und'").count() == 0


def test_every_language_has_a_dictionary(spark):
    rng = random.Random(8)
    tongues = {"aa": ["thon", "erea", "inge", "atst"], "long": ["schei", "ungen", "keit", "pfer"], "often": ["oko", "vlad", "stvo", "prze"]}
    long = [words(rng, 3000, [a + b for a in tongues["long"] for b in tongues["long"]]) for _ in range(3)]
    short = [words(rng, 40, tongues["aa"]) for _ in range(50)]
    often = [words(rng, 40, tongues["often"]) for _ in range(3)]
    rows = [(t, "aa") for t in short] + [(t, "long") for t in long] + [(often[i % 3], "often") for i in range(6000)]
    rows += [("zq", "tiny"), ("123", "none"), (None, "none"), ("", "none")]
    made = dict(langid.fit(spark.createDataFrame(rows, "text string, lang string")))
    assert list(made) == ["often", "aa", "long", "tiny"] and min(map(len, made.values())) >= 8
    assert made["often"].count(b"\n") == 2 and made["long"].count(b"\n") >= 3 * min(map(len, long)) // langid.LONGEST - 1
    df = spark.createDataFrame(list(enumerate([short[0], long[0][:300], often[0]])), "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, list(made.items())).collect()} == {0: "aa", 1: "long", 2: "often"}


def test_toxicity_finds_sentences(spark):
    rng = random.Random(4)
    vocab = ["thon", "erea", "inge", "atst", "whou", "lost", "edon", "rest"]
    rows, labels = [], []
    for i in range(300):
        parts = [words(rng, 8, vocab) for _ in range(5)]
        if i % 4 == 0:
            parts[i % 5] += " " + rng.choice(["scum", "moron"])
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "thon " * 20000)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.fit_on(df, known)
    assert set(weights) == {b"scum", b"moron"}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, weights).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300)) and got[900] == got[901] == got[902] == 0
    place = {r["doc_id"]: r["place"] for r in toxicity.sentences(df, weights).collect()}
    assert place == {i: i % 5 for i in range(0, 300, 4)}


# --- token files -------------------------------------------------------------


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 70000, 3000), rng.integers(0, 200, 65), np.array([0]), np.array([2**32 - 1, 5]), np.zeros(0, int)):
        seg = dac.Segment(dac.encode(ids))
        assert len(seg) == len(ids) and [seg[i] for i in range(len(ids))] == ids.tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
            assert seg.slice(a, b).tolist() == ids[a:b].tolist()


@pytest.fixture(scope="module")
def word_tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_token_files_equal_the_library(spark, texts, tmp_path, word_tokenizer):
    from tokenizers import Tokenizer

    odd = ["a <|endoftext|> b", "A<|ENDOFTEXT|>b <|startoftext|><|endoftext|>.", "K\u00f6se, Kose\u0301. e\u0301\u0338, =\u0338 x=\u0338", "it's 'tis rock'n'roll's l'été,", "ΑΣ, ΑΣ. ΟΔΟΣ", "3.14, a1b2 x_y_z... —, ½.", "a\u00a0b\u3000c\x1cd", "İI ß"]
    rows = [(i, t) for i, t in enumerate(texts + odd)] + [(None, "no id"), (3, "again"), (3, "again"), (-7, "first")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, part string").repartition(3)
    tok = Tokenizer.from_str(word_tokenizer)
    for name, frequent, plain in (("a", 5, False), ("b", 1 << 18, False), ("c", 1 << 18, True)):
        tok.encode_special_tokens = plain
        path = f"file://{tmp_path}/{name}"
        dac.write_segments(df, path, word_tokenizer, segment_ids=700, frequent=frequent, range_bytes=9000, special_as_text=plain)
        want, got = Counter(), dac.read_documents(spark, path).collect()
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        start = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == start
            start += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda i: (i is not None, i))


def test_token_files_of_one_id_and_of_nothing(spark, tmp_path, word_tokenizer):
    df = spark.createDataFrame([(5, f"word {k} " * 40) for k in range(600)], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/one"
    dac.write_segments(df, path, word_tokenizer, range_bytes=20_000)
    files = spark.read.parquet(path)
    assert files.select("part").distinct().count() > 5
    sizes = [r["n_tokens"] for r in dac.read_documents(spark, path).orderBy("start").collect()]
    starts = [r["start"] for r in dac.read_documents(spark, path).orderBy("start").collect()]
    assert len(sizes) == 600 and starts == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    dac.write_segments(empty(spark), f"file://{tmp_path}/none", word_tokenizer)
    assert dac.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_single_tokens_are_read_by_place(spark, docs, texts, tmp_path, word_tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(word_tokenizer)
    path = f"file://{tmp_path}/tokens"
    dac.write_segments(docs, path, word_tokenizer, segment_ids=300, range_bytes=9000)
    ids = [i for t in texts for i in tok.encode(t or "", add_special_tokens=False).ids + [2]]
    asked = sorted({*range(0, len(ids), 37), 0, len(ids) - 1})
    places = spark.createDataFrame([(x,) for x in [*asked, len(ids), len(ids) + 10**9]], "place long")
    got = {r["place"]: r["token_id"] for r in dac.read_tokens(spark, path, places, segment_ids=300).collect()}
    assert got == {x: ids[x] for x in asked}


# --- decontamination ---------------------------------------------------------


def test_tiling_catches_copies_and_reordered_passages(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, ". ".join(words(rng, 8, vocab).capitalize() for _ in range(4))) for k in range(6)] + [(90, None), (91, "w1 w2")]
    parts = items[1][1].split(". ")
    rows = [
        (0, words(rng, 200, vocab)), (1, f"{words(rng, 50, vocab)} {items[0][1].upper()} {words(rng, 50, vocab)}"),
        (2, ". ".join([parts[2], parts[0], words(rng, 30, vocab), parts[3], parts[1]])), (3, None), (4, ""),
        (5, parts[0]), (6, items[2][1] + " " + items[3][1]), (6, items[2][1] + " " + items[3][1]),
    ]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(df, bench).collect())
    assert got == [(1, 0), (2, 1), (6, 2), (6, 2), (6, 3), (6, 3)]
    kept = tiling.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    assert tiling.contaminated(df, bench.limit(0)).count() == 0


def slow_tiles(text, item, least):
    """Greedy string tiling by definition: the longest match of unmarked tokens, again and again."""
    text, item, out = list(text), list(item), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] != None:  # noqa: E711
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < least:
            return out
        out.append((t, i, n))
        text[t : t + n] = [None] * n
        item[i : i + n] = [None] * n


def test_tiles_equal_slow_tiling():
    rng = random.Random(21)
    for case in range(120):
        vocab = [b"w%d" % k for k in range(rng.choice((1, 2, 3, 30)))]
        item = [rng.choice(vocab) for _ in range(rng.randrange(1, 40))]
        text = [rng.choice([*vocab, b"x"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[a : a + rng.randrange(1, 20)]
        number = {w: k + 1 for k, w in enumerate({*item, *text})}
        fast = tiling.tile(np.array([number[w] for w in text], np.uint64), np.array([number[w] for w in item], np.uint64))
        slow = slow_tiles(text, item, 5)
        assert sorted(fast) == sorted(slow), case
        if len(item) >= 5:
            assert tiling.compare(text, item)[0] == sum(n for _, _, n in slow)


def test_long_items_are_tiled_fast():
    import time

    rng = random.Random(22)
    item = [b"w%d" % rng.randrange(3000) for _ in range(20_000)]
    began = time.time()
    assert tiling.compare(item[10_000:] + [b"x"] * 50 + item[:10_000], item) == (20_000, 10_000)
    assert tiling.compare([b"a"] * 3000, [b"a"] * 500) == (500, 500)
    assert time.time() - began < 20


def test_items_of_any_script_and_length_are_found(spark):
    items = [(1, "Who ARE you?"), (2, "今日は良い天気ですね散歩に行きましょう"), (3, "ÉTÉ à la plage, “déjà vu” — toujours"), (4, "!!!"), (5, None), (5, "one"), (None, "Who are you")]
    rows = [(1, "well, who are you then"), (2, "x 今日は良い天気ですね散歩に行きましょう。"), (3, "été À LA plage déjà vu toujours!"), (None, "who are they, one"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit(1), "seeds": F.lit("s"), "item": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in tiling.contaminated(df, bench).collect())
    assert got == Counter([(1, 1), (1, None), (2, 2), (3, 3), (None, 5)])
    kept = tiling.keep_clean(df, bench)
    assert kept.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, None), (5, "")])
    assert tiling.contaminated(df.limit(0), bench).count() == 0 and tiling.keep_clean(df, bench.limit(0)).count() == 6


def test_frequent_words_stay_within_bound(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(500)], "word string, n long")
    for limit in (0, 1, 7, 100, 500, 1000):
        top, rest = common.most_frequent(df, limit)
        assert top.count() <= limit and top.count() + rest.count() == 500
        if top.count() and rest.count():
            assert top.agg({"n": "min"}).first()[0] > rest.agg({"n": "max"}).first()[0]


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(120)] + ["the same words again and again"] * 60 + [None, ""]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(lbl, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lbl, "CHUNK", 300)
    one, many = [sorted((r["doc_id"], r["n_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in lbl.score(docs.repartition(n), ~lbl.held_out(), own=20).collect()) for n in (1, 16)]
    assert one == many
