"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts of every whole text are taken in its own row: no explode of words, no shuffle. Repeated five-word windows are found
with 64-bit window hashes: a hash set tells whether a text has any repeat, and only then are its windows sorted.

The cascade's order comes from a sample of rows by chance: each rule is run on it alone, which gives the share of rows it
rejects and the time it takes beyond the words that all of them need; rules stand by rejection per cost. ``keep`` takes
the counts of a rule only in rows that no rule before it rejects; ``judge`` returns all counts and takes them once. The
verdict doesn't depend on the order, only the work and the name of the first rule that rejects.

Defined cases: a null or empty text has no word, all counts zero, and fails the base rules; null and repeated ids are kept
as they are; repeated rows are judged apart; texts may have any length; an empty table keeps the rules' given order; other
columns are ignored (``judge``) or kept as they are (``keep``), whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, settle

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Rows that the order is estimated on, about.
SAMPLE_ROWS = 1024


@dataclass(frozen=True)
class Rule:
    """reject takes the columns text, words and base counts by name, and is true for rows to reject."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


BASE = (
    Rule("few_words", lambda c: c["n_words"] < 10),
    Rule("repeat_words", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
)
RULES = (
    Rule("symbols", lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("duplicate_lines", lambda c: (c["n_dup_lines"] > 2) & (10 * c["n_dup_lines"] > 3 * F.size(F.split(c["text"], "\n", -1)))),
    Rule("capitals", lambda c: 2 * _without(c["text"], "[A-Z]") > c["word_chars"]),
    Rule("exclamations", lambda c: 5 * _without(c["text"], "!") > 2 * c["n_words"]),
    Rule("letterless_words", lambda c: 5 * F.size(F.filter(c["words"], lambda w: ~w.rlike(r"\p{L}"))) > 2 * c["n_words"]),
)


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n = F.size(words)
    grams = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])),
        F.lit(1),
        F.greatest(n - (WINDOW - 1), F.lit(0)),
    )

    def covered(held: Column) -> Column:
        placed = F.sort_array(F.transform(held, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            met = F.transform(
                s,
                lambda e, k: F.when(
                    (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]
                ),
            )
            return F.sort_array(F.array_compact(met))

        def total(p: Column) -> Column:
            parts = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(bind(placed, starts), total)

    return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))


def split_words(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """kept columns with text (null as empty) and words, from the column text.

    Words come out of a generator, so that what uses them never splits the text again.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE, -1), "")
    rows = docs.select(*kept, F.explode(F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), words.alias("words")))).alias("s"))
    return rows.select(*[c for c in rows.columns if c != "s"], "s.text", "s.words")


def count_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _without(text, SYMBOLS).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def _inputs() -> dict[str, Column]:
    """What rules take, each count made where it is used."""
    text, words = F.col("text"), F.col("words")
    return {"text": text, "words": words} | count_columns(text, words)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, both measured on a sample of docs; an empty sample keeps the given order."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = settle(docs.select("text").sample(share, seed=3), "rule_sample")
    words = split_words(sample, [])

    def run(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        found = words.agg(F.avg(condition.cast("int"))).first()[0] or 0.0
        return found, time.perf_counter() - began

    run(F.size("words") > 0)
    floor = run(F.size("words") > 0)[1]
    seen = [run(r.reject(_inputs())) for r in rules]
    worth = [found / max(took - floor, 1e-3) for found, took in seen]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i))]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, first_rule (null if none rejects) and kept.

    sample_rows is about how many rows the cascade's order is estimated on.
    """
    order = order_rules(docs, BASE + tuple(rules), sample_rows)
    counts = {n: c.alias(n) for n, c in count_columns(F.col("text"), F.col("words")).items()}
    words = split_words(docs, [F.col("doc_id")])
    # The counts, too, come out of a generator.
    rows = words.select("doc_id", "text", "words", F.explode(F.array(F.struct(*counts.values()))).alias("c")).select("doc_id", "text", "words", "c.*")
    known = {n: F.col(n) for n in ("text", "words", *counts)}
    first = F.coalesce(*[F.when(r.reject(known), F.lit(r.name)) for r in order])
    base = BASE[0].reject(known) | BASE[1].reject(known)
    marked = rows.withColumn("first_rule", first)
    return marked.select("doc_id", *counts, base.alias("base_failed"), "first_rule", F.col("first_rule").isNull().alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns alone."""
    order = order_rules(docs, BASE + tuple(rules), sample_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = split_words(docs.select(row, "text"), [F.col("row")])
    inputs, passed = _inputs(), F.lit(True)
    for rule in reversed(order):
        passed = F.when(rule.reject(inputs), F.lit(False)).otherwise(passed)
    return held.where(passed).select("row.*")


ORACLE = r"""
with docs as (
  select doc_id, coalesce(text, '') as text from documents
), w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs
), flat as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w
), grams as (
  select doc_id, i, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p as gram
  from flat window p as (partition by doc_id order by i)
), met as (
  select doc_id, i, count(*) over (partition by doc_id, gram) as times from grams where gram is not null
), starts as (
  select doc_id, i, lead(i) over (partition by doc_id order by i) as next_i from met where times > 1
), repeats as (
  select doc_id, sum(least(5, coalesce(next_i - i, 5))) as n from starts group by doc_id
), split_lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line from docs
), dup_lines as (
  select doc_id, count(*) - count(distinct line) as n from split_lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), counts as (
  select w.doc_id, text, words, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(d.n, 0) as bigint) as n_dup_lines,
    cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from w left join repeats r on r.doc_id = w.doc_id left join dup_lines d on d.doc_id = w.doc_id
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    10 * n_symbols > 3 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or n_dup_lines > 2 and 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
    or 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
    or 5 * (length(text) - length(replace(text, '!', ''))) > 2 * n_words
    or 5 * len(list_filter(words, lambda x: not regexp_matches(x, '\p{L}'))) > 2 * n_words as rejected
  from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not rejected as kept
from judged
"""
