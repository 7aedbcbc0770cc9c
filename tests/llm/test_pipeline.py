"""The pipeline against a brute-force run of its stages, and the registered names."""

import random
from collections import Counter

import numpy as np
import pytest

from wordweft.llm import cnn, toxicity

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from .test_operators import slow_components, slow_counts, slow_fingerprint, words  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in ("th", "of", "un", "mo", "ka", "be") for b in ("e", "a", "o") for c in ("r", "nt", "st", "ng", "ll")]
    items = [(k, words(rng, 25, vocab)) for k in range(4)]
    rows, labels = [], []
    for i in range(160):
        text = words(rng, rng.randrange(30, 90), vocab)
        if i % 8 == 3:
            text = " ".join(w + "%%" for w in text.split()[: 40 if i % 16 == 3 else 12]) + " " + text
        if i % 20 == 7:
            text = f"{text} {items[i % 4][1]} {words(rng, 10, vocab)}"
        if i % 10 == 9:
            text = rows[i - 1][1]
        rows.append((i, text, "en", "s", len(text)))
        if i % 2:
            labels.append((i, int(i % 8 != 3), 0))
    rows += [(200, None, "en", None, None), (201, "", None, "s", 0), (202, "short text", "en", "s", 10)]
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, items


def slow_rejects(text):
    n, chars, symbols, dup, repeat = slow_counts(text)
    t = text or ""
    return (
        n < 10 or 100 * repeat > 20 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 20 * n or (dup > 2 and 10 * dup > 3 * len(t.split("\n")))
        or 2 * sum("A" <= c <= "Z" for c in t) > chars or 5 * t.count("!") > 2 * n or 5 * sum(not any(c.isalpha() for c in w) for w in t.split()) > 2 * n
    )


def test_pipeline_equals_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    from wordweft.llm import bpe

    base, rows, items = folder
    kept = [(i, t) for i, t, *_ in rows if not slow_rejects(t)]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, base)
    assert first.columns == docs.columns and sorted(r["doc_id"] for r in first.collect()) == [i for i, _ in kept]
    known = toxicity.training_sample(docs, spark.read.parquet(f"{base}/labels.parquet"), "quality", cnn.SAMPLE_DOCS, cnn.held_out())
    model = cnn.fit([bytes(t) for t in known["text"]], known["label"].to_numpy() == 1)
    kept = [(i, t) for i, t in kept if cnn.probability(t.encode(), model) >= cnn.THRESHOLD]
    names = slow_components([slow_fingerprint(t) for _, t in kept], [i for i, _ in kept], 4)
    kept = [(i, t) for (i, t), c in zip(kept, names) if i == c]
    kept = [(i, t) for i, t in kept if not any(text in t for _, text in items)]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, base).collect()}
    assert out == {i: len(whole.encode_ordinary(t)) for i, t in kept}
    assert 0 < len(out) < len(rows) and np.mean(list(out.values())) > 10


def test_names_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    numbers = Counter(int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit())
    assert numbers == {k: 1 for k in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "byte_bpe"]
