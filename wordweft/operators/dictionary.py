"""Dictionary build: raw entries to gloss trees, tokens, link index and word list."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import ENTRY_KEYS, LEXICAL_KEYS, LINKAGES, POS_TAGS, PRINTABLE, SENSE_KEYS
from ..functions.scalars import field_diff, gloss_remainder, norm_word, present_fields, sense_depth
from ..sources.io import stored_rows, write_dictionary
from ..sources.shared import discard, settle, small_batches
from .jsontree import find_tokens

TOKEN = "array<struct<w:string,l:string,p:string,s:string>>"


def group_entries(raw: DataFrame, order: str = "ord") -> DataFrame:
    """word, entries: all entries of lower(word) in input order."""
    rest = F.struct(order, *[c for c in raw.columns if c != order])
    return raw.where("word is not null").groupBy(norm_word(F.col("word")).alias("word")).agg(F.array_sort(F.collect_list(rest)).alias("entries"))


def printable_fields(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Object-array fields as arrays of (value): a missing sub-field stays as an empty object, a null field goes."""
    def only(key: str) -> Column:
        return F.transform(key, lambda x: F.struct(x[PRINTABLE[key]].alias("value"))).alias(key)

    return raw.select(*[only(c) if c in keys else F.col(c) for c in raw.columns])


def entries_of(raw: DataFrame, order: str = "ord") -> DataFrame:
    """raw with word key and entry_ix, the entry's place among those of its key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1
    return raw.withColumn("key", norm_word(F.col("word"))).withColumn("entry_ix", place)


def _bad_entry() -> Column:
    """What is wrong with an entry, null if nothing is."""
    empty = F.exists("senses", lambda s: F.size(s["glosses"]) == 0)
    return F.when(F.col("word").isNull(), "null word").when(F.col("senses").isNull(), "no senses").when(empty, "empty glosses")


def rejected_words(raw: DataFrame) -> DataFrame:
    """word, reason: a bad entry takes its whole word along."""
    return raw.select(norm_word(F.col("word")).alias("word"), _bad_entry().alias("reason")).where("reason is not null").groupBy("word").agg(F.min("reason").alias("reason"))


def good_entries(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Entries with key and entry_ix, without those of rejected words."""
    bad = rejected_words(raw).where("word is not null").select(F.col("word").alias("key"))
    return entries_of(raw.where("word is not null"), order).join(bad, "key", "left_anti")


def gloss_parents(senses: DataFrame, entry: list[str]) -> DataFrame:
    """senses (entry columns, ix, depth) with parent_ix: the latest earlier sense one level up, never reset.

    Each sense stands as a giver at its depth and, below the first level, as a taker one level up, so one sort by
    (entry, level, ix) serves any number of levels.
    """
    giver = senses.select(*entry, F.col("depth").alias("level"), "ix", F.col("ix").alias("given"))
    taker = senses.where("depth > 1").select(*entry, (F.col("depth") - 1).alias("level"), "ix", F.lit(None).cast("int").alias("given"))
    window = Window.partitionBy(*entry, "level").orderBy("ix", F.col("given").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = giver.unionByName(taker).withColumn("parent_ix", F.last("given", ignorenulls=True).over(window)).where("given is null")
    return senses.join(seen.select(*entry, "ix", "parent_ix"), [*entry, "ix"], "left")


def sense_rows(raw: DataFrame, order: str = "ord") -> DataFrame:
    """word, entry_ix, ix, depth, glosses and the sense's printable fields as arrays of strings; bad words left out."""
    return _senses(good_entries(raw, order).withColumn("word", F.col("key")), ["word", "entry_ix"])


def _senses(good: DataFrame, entry: list[str]) -> DataFrame:
    flat = good.select(*entry, F.posexplode("senses").alias("ix", "sense"))
    fields = [F.transform(f"sense.{k}", lambda x: x[PRINTABLE[k]]).alias(k) for k in [*LINKAGES, "examples"]]
    return flat.select(*entry, "ix", sense_depth(F.col("sense.glosses")).alias("depth"), F.col("sense.glosses").alias("glosses"), *fields)


def gloss_tree(raw: DataFrame, order: str = "ord") -> DataFrame:
    """word, entry_ix, ix, parent_ix, depth, sibling_ix, gloss and each field without what the parent has."""
    return _tree(sense_rows(raw, order), ["word", "entry_ix"])


def _tree(senses: DataFrame, entry: list[str]) -> DataFrame:
    linked = gloss_parents(senses, entry)
    kept = [*LINKAGES, "examples"]
    above = senses.select(*entry, F.col("ix").alias("parent_ix"), F.coalesce(F.size("glosses"), F.lit(0)).alias("p_length"), F.col("glosses").isNull().alias("p_bare"), *[F.col(k).alias(f"p_{k}") for k in kept])
    joined = linked.join(above, [*entry, "parent_ix"], "left")
    length = F.when(F.col("parent_ix").isNull() | F.col("p_bare"), 0).otherwise(F.col("p_length"))
    sibling = F.row_number().over(Window.partitionBy(*entry, "parent_ix").orderBy("ix")) - 1
    return joined.select(
        *entry, "ix", "parent_ix", "depth", sibling.alias("sibling_ix"), gloss_remainder(F.col("glosses"), length).alias("gloss"),
        *[field_diff(F.col(k), F.col(f"p_{k}")).alias(k) for k in kept],
    )


def gloss_outline(nodes: DataFrame) -> DataFrame:
    """nodes with marker: numbers at the first level, letters (cycling) at the second, bullets below."""
    letter = F.chr(F.lit(97) + F.col("sibling_ix") % 26)
    mark = F.when(F.col("depth") == 1, F.concat((F.col("sibling_ix") + 1).cast("string"), F.lit("."))).when(F.col("depth") == 2, F.concat(letter, F.lit("."))).otherwise("•")
    return nodes.withColumn("marker", mark)


def field_texts(raw: DataFrame, order: str = "ord") -> DataFrame:
    """word, entry_ix, ix (null for entry fields), lexical_key, text: every printable string once."""
    tree = gloss_tree(raw, order)
    good = good_entries(raw, order)
    def each(rows: DataFrame, fields: list[Column]) -> DataFrame:
        held = rows.select("word", "entry_ix", "ix", F.explode(F.array(*fields)).alias("f"))
        return held.select("word", "entry_ix", "ix", F.col("f.k").alias("lexical_key"), F.explode("f.texts").alias("text"))

    def named(key: str, texts: Column) -> Column:
        return F.struct(F.lit(key).alias("k"), texts.alias("texts"))

    whole = good.select(F.col("key").alias("word"), "entry_ix", F.lit(None).cast("int").alias("ix"), *ENTRY_KEYS)
    entry = each(whole, [named(k, F.transform(k, lambda x: x[PRINTABLE[k]])) for k in ENTRY_KEYS])
    sense = each(tree, [named(k, F.col(k)) for k in [*LINKAGES, "examples"]] + [named("glosses", F.array("gloss"))])
    return entry.unionByName(sense).where("text is not null")


def rule_tokenizer(text: str, lexicon: dict[str, tuple[str, str]]) -> list[dict]:
    """Spaces and marks as literals (s), other runs as tokens (w, l, p); unknown words are nouns with plain lemmas."""
    import re

    out = []
    for run in re.findall(r"\s+|[^\W_]+(?:['-][^\W_]+)*|[\W_]", text):
        if run.isspace() or not re.match(r"[^\W_]", run):
            out.append({"w": None, "l": None, "p": None, "s": run})
            continue
        low = run.lower()
        lemma, tag = lexicon.get(low, (low[:-1] if len(low) > 3 and low.endswith("s") else low, "NUM" if low.isdigit() else "NOUN"))
        if tag not in POS_TAGS:
            raise ValueError(f"unknown tag {tag} of {run}")
        out.append({"w": run, "l": lemma, "p": tag, "s": None})
    return out


def tokenize(text: Column, lexicon: dict[str, tuple[str, str]] | None = None, tokenizer: Callable | None = None) -> Column:
    """Rich text of a column; tokenizer(text, lexicon) may be the caller's own."""
    own, words = tokenizer or rule_tokenizer, lexicon or {}

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([own(t, words) if t is not None else None for t in texts])

    return F.pandas_udf(run, TOKEN)(text)


def flat_tokens(texts: DataFrame, lexicon: dict | None = None, tokenizer: Callable | None = None) -> DataFrame:
    """word, lexical_key, w, l, pos; each distinct text is tokenised once."""
    rich = texts.select("text").distinct().withColumn("rich", tokenize(F.col("text"), lexicon, tokenizer))
    each = texts.join(rich, "text").select("word", "lexical_key", F.explode("rich").alias("t")).where("t.w is not null")
    return each.select("word", "lexical_key", F.col("t.w").alias("w"), F.col("t.l").alias("l"), F.col("t.p").alias("pos"))


@lru_cache(maxsize=1 << 16)
def _token_json(w: str | None, low: str | None, p: str | None, s: str | None) -> str:
    return json.dumps(s if w is None else {"w": w, "l": low, "p": p}, ensure_ascii=False, separators=(",", ":"))


def rich_texts(texts: Column, lexicon: dict[str, tuple[str, str]] | None = None, tokenizer: Callable | None = None) -> Column:
    """The texts of an array of arrays as JSON: an array of {w, l, p} and plain strings each; null texts and arrays stay null."""
    own, words = tokenizer or rule_tokenizer, lexicon or {}

    def one(text: str | None) -> str | None:
        return None if text is None else "[" + ",".join([_token_json(t["w"], t["l"], t["p"], t["s"]) for t in own(text, words)]) + "]"

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[None if field is None else [one(t) for t in field] for field in row] for row in rows])

    return F.pandas_udf(run, "array<array<string>>")(texts)


def _json_text(value: Column) -> Column:
    """A string as a JSON string; null stays null."""
    held = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substr(held, F.lit(2), F.length(held) - 2))


def _members(rich: Column, keys: list[str]) -> Column:
    """The members of a JSON object, one a key whose array isn't null, each item an object with the printable sub-field."""

    def member(place: int, key: str) -> Column:
        field = F.get(rich, F.lit(place))
        if key == "glosses":
            return F.concat(F.lit('"glosses":'), F.get(field, F.lit(0)))
        item = F.transform(field, lambda t: F.coalesce(F.concat(F.lit(f'{{"{PRINTABLE[key]}":'), t, F.lit("}")), F.lit("{}")))
        return F.concat(F.lit(f'"{key}":['), F.array_join(item, ","), F.lit("]"))

    return F.array_join(F.array_compact(F.array(*[member(i, k) for i, k in enumerate(keys)])), ",")


def _joined(place: str, value: str) -> Column:
    """The values of a group in the order of place, with commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]), ",")


def nested_senses(nodes: DataFrame, entry: list[str], scratch: list[DataFrame] | None = None) -> DataFrame:
    """entry columns and senses, the JSON array of an entry's gloss tree, from flat nodes (entry, ix, parent_ix, depth, fields).

    Nodes of the deepest level are written first; a level's nodes take in what stands below them, so a round costs one
    grouping by parent and one join, and rounds are as many as the tree has levels. A node without a parent stands at the top
    whatever its depth. Parents are one level above. scratch: gets the tables that the result reads.
    """
    scratch = [] if scratch is None else scratch
    nodes = settle(nodes.select(*entry, "ix", "parent_ix", "depth", "fields"), "nodes", compression="zstd")
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    below, tops = None, []
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("children", F.lit("")) if below is None else level.join(below, [*entry, "ix"], "left")
        text = F.concat(F.lit('{"children":['), F.coalesce("children", F.lit("")), F.lit('],"lexicalFields":{'), "fields", F.lit("}}"))
        made = settle(level.select(*entry, "ix", "parent_ix", text.alias("node")), "level", compression="zstd")
        scratch.append(made)
        tops.append(made.where("parent_ix is null"))
        held = made.where("parent_ix is not null").withColumnRenamed("ix", "place")
        below = held.groupBy(*entry, F.col("parent_ix").alias("ix")).agg(_joined("place", "node").alias("children"))
    discard(nodes)
    return reduce(DataFrame.unionByName, tops).groupBy(*entry).agg(F.concat(F.lit("["), _joined("ix", "node"), F.lit("]")).alias("senses"))


def dictionary_entries(raw: DataFrame, lexicon: dict | None = None, tokenizer: Callable | None = None, order: str = "ord", scratch: list[DataFrame] | None = None) -> DataFrame:
    """word, entry_ix, entry: one row an entry, a JSON object {pos, senses, entry fields}; see ``dictionary_records``.

    scratch: gets the tables that the result reads, for whoever stores it to remove.
    """
    scratch = [] if scratch is None else scratch
    small_batches(raw.sparkSession)
    entry, kept = ["row"], [*LINKAGES, "examples"]
    fields = F.array(*[F.col(k) for k in kept], F.when(F.col("gloss").isNotNull(), F.array("gloss")))
    held = settle(raw.where("word is not null").withColumn("row", F.monotonically_increasing_id()), "raw", compression="zstd")
    scratch.append(held)
    # Entries are numbered by word as narrow rows, so that those of a frequent word never meet whole in one task.
    placed = good_entries(held.select("row", "word", F.col(order).alias("ord"), "senses"), "ord").select("row", F.col("key").alias("word"), "entry_ix")
    flat = settle(_senses(held.where(_bad_entry().isNull()), entry), "senses", compression="zstd")
    tree = _tree(flat, entry).select(*entry, "ix", "parent_ix", "depth", rich_texts(fields, lexicon, tokenizer).alias("rich"))
    senses = nested_senses(tree.withColumn("fields", _members(F.col("rich"), [*kept, "glosses"])), entry, scratch)
    discard(flat)
    own = F.array(*[F.transform(k, lambda x: x[PRINTABLE[k]]) for k in ENTRY_KEYS])
    whole = held.select(*entry, "pos", rich_texts(own, lexicon, tokenizer).alias("rich")).join(placed, entry).join(senses, entry, "left")
    parts = F.array(
        F.concat(F.lit('"pos":'), _json_text(F.col("pos"))), F.concat(F.lit('"senses":'), F.coalesce("senses", F.lit("[]"))), F.nullif(_members(F.col("rich"), ENTRY_KEYS), F.lit("")),
    )
    return whole.select("word", "entry_ix", F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}")).alias("entry"))


def dictionary_records(raw: DataFrame, lexicon: dict | None = None, tokenizer: Callable | None = None, order: str = "ord") -> DataFrame:
    """word, lexical_entries: one row a word, its entries in input order as a JSON array of {pos, senses, entry fields}.

    Texts are rich texts. Fields that are null go, empty arrays stay, items without their printable sub-field are {}. An entry
    with an empty array of senses has none; a bad entry takes its whole word along (see ``rejected_words``).
    """
    made = dictionary_entries(raw, lexicon, tokenizer, order)
    return made.groupBy("word").agg(F.concat(F.lit("["), _joined("entry_ix", "entry"), F.lit("]")).alias("lexical_entries"))


def _tokens_below(value: dict | list) -> set[tuple]:
    """(key, p, w, l) of every object with members w, l and p (p not null) below each lexical key above it."""
    found, rest = set(), [(value, frozenset())]
    while rest:
        value, above = rest.pop()
        if isinstance(value, list):
            rest += [(v, above) for v in value if isinstance(v, (list, dict))]
            continue
        if above and value.get("p") is not None and "w" in value and "l" in value:
            found.update((k, value["p"], value["w"], value["l"]) for k in above)
        rest += [(v, above | {k} if k in LEXICAL_KEYS else above) for k, v in value.items() if isinstance(v, (list, dict))]
    return found


def entry_links(entries: DataFrame) -> DataFrame:
    """word, link_field, lexical_key, pos, targets (sorted): every token of the stored entries under each key it stands below.

    An entry's JSON is opened by itself, and only distinct tokens leave its task.
    """

    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([list(_tokens_below(json.loads(text))) for text in texts])

    small_batches(entries.sparkSession)
    read = F.pandas_udf(tokens, "array<struct<lexical_key:string,pos:string,w:string,l:string>>")
    held = entries.select("word", F.explode(read("entry")).alias("t")).select("word", "t.*")
    return link_index(held).groupBy("word", "link_field", "lexical_key", "pos").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def seed_entries(raw: DataFrame, path: str, lexicon: dict | None = None, tokenizer: Callable | None = None, order: str = "ord") -> bool:
    """Store ``dictionary_entries`` at path unless entries stand there already; True if they were built.

    The layout for words with any number of entries: a row is as large as an entry, and never holds all that a word has.
    """
    if stored_rows(raw.sparkSession, path, 1):
        return False
    scratch: list[DataFrame] = []
    dictionary_entries(raw, lexicon, tokenizer, order, scratch).write.mode("overwrite").option("compression", "zstd").parquet(path)
    discard(*scratch)
    return True


def record_links(records: DataFrame) -> DataFrame:
    """word, all_links of records (word, lexical_entries): every token of the stored JSON under each key it stands below."""
    tokens = find_tokens(records.select("word", "lexical_entries"), LEXICAL_KEYS, "lexical_entries")
    return links_to_map(link_index(tokens.withColumnRenamed("p", "pos")))


def seed_dictionary(raw: DataFrame, path: str, min_rows: int = 1_454_988, lexicon: dict | None = None, tokenizer: Callable | None = None, order: str = "ord") -> bool:
    """Build the dictionary at path unless it has min_rows rows already; True if it was built."""
    if stored_rows(raw.sparkSession, path, min_rows) >= min_rows:
        return False
    records = settle(dictionary_records(raw, lexicon, tokenizer, order), "records")
    write_dictionary(records, record_links(records), path)
    return True


def entry_fields(records: DataFrame) -> DataFrame:
    """word, fields: the entry fields that any entry of the word has, in key order; words without one have an empty array."""
    entries = F.from_json("lexical_entries", "array<map<string,string>>")
    named = F.array_distinct(F.flatten(F.transform(entries, F.map_keys)))
    return records.select("word", F.filter(present_fields(named), lambda k: k.isin(ENTRY_KEYS)).alias("fields"))


def fields_of_entries(entries: DataFrame) -> DataFrame:
    """word, fields: ``entry_fields`` of rows (word, entry), one an entry."""
    named = F.filter(F.json_object_keys("entry"), lambda k: k.isin(ENTRY_KEYS))
    each = entries.select("word", F.explode_outer(named).alias("k")).groupBy("word").agg(F.collect_set("k").alias("named"))
    return each.select("word", present_fields(F.col("named")).alias("fields"))


def link_index(tokens: DataFrame) -> DataFrame:
    """word, link_field, lexical_key, pos, target: surface and lemma values, each distinct on its own, in one pass."""
    sides = F.array(*[F.struct(F.lit(f).alias("link_field"), F.col(f).alias("target")) for f in ("w", "l")])
    flat = tokens.select("word", "lexical_key", "pos", F.explode(sides).alias("side"))
    found = flat.select("word", F.col("side.link_field").alias("link_field"), "lexical_key", "pos", F.col("side.target").alias("target"))
    return found.where("target is not null").distinct()


def links_to_map(links: DataFrame) -> DataFrame:
    """word, all_links: link field to key to tag to sorted words."""
    by_tag = links.groupBy("word", "link_field", "lexical_key", "pos").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    by_key = by_tag.groupBy("word", "link_field", "lexical_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "targets")))).alias("m"))
    by_field = by_key.groupBy("word", "link_field").agg(F.map_from_entries(F.collect_list(F.struct("lexical_key", "m"))).alias("m"))
    return by_field.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("link_field", "m"))).alias("all_links"))


def word_list(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("word").where("word is not null").distinct()


def build_dictionary(raw: DataFrame, lexicon: dict | None = None, tokenizer: Callable | None = None, order: str = "ord") -> dict[str, DataFrame]:
    """The tables of a build: rejects, tree, texts, tokens, links, words."""
    tree, texts = gloss_tree(raw, order), field_texts(raw, order)
    tokens = flat_tokens(texts, lexicon, tokenizer)
    words = word_list(entries_of(raw.where("word is not null"), order).select(F.col("key").alias("word")).join(rejected_words(raw).select("word"), "word", "left_anti"))
    return {"rejects": rejected_words(raw), "tree": tree, "texts": texts, "tokens": tokens, "links": link_index(tokens), "words": words}


def upsert_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words with those of the dictionary that were missing."""
    fresh = word_list(dictionary).join(words.select("word"), "word", "left_anti")
    return words.select("word").unionByName(fresh)


def embeddable_words(words: DataFrame, strict: bool = True) -> DataFrame:
    """Words without white space (strict), or without a blank."""
    return words.where(~F.col("word").rlike(r"\s") if strict else ~F.col("word").like("% %"))


def word_pattern_filter(words: DataFrame, pattern: str = "^[a-z]{4,12}$") -> DataFrame:
    return words.where(F.col("word").rlike(pattern))


def field_presence(fields: DataFrame) -> DataFrame:
    """word, level (entry or sense), lexical_key: fields that are there, empty arrays too."""
    return fields.select("word", "level", "lexical_key").distinct()


def select_fields(fields: DataFrame, games: DataFrame) -> DataFrame:
    """Rows of fields (word, level, lexical_key, ...) that each game shows: game_id with the row."""
    chosen = games.select("game_id", F.lit("entry").alias("level"), F.explode("entry_fields").alias("lexical_key")).unionByName(
        games.select("game_id", F.lit("sense").alias("level"), F.explode("sense_fields").alias("lexical_key"))
    )
    allowed = F.when(F.col("level") == "entry", F.col("lexical_key").isin(ENTRY_KEYS)).otherwise(F.col("lexical_key").isin(SENSE_KEYS))
    return fields.join(chosen.where(allowed), ["level", "lexical_key"])


def check_records(pairs: DataFrame, words: DataFrame, fields: DataFrame, games: DataFrame) -> DataFrame:
    """word, game_id and reason: missing word, no content, or null for a playable record."""
    asked = pairs.select(F.lower("word").alias("word"), "game_id").distinct()
    shown = select_fields(field_presence(fields), games).select("word", "game_id").distinct().withColumn("shown", F.lit(True))
    known = words.select("word").distinct().withColumn("known", F.lit(True))
    joined = asked.join(known, "word", "left").join(shown, ["word", "game_id"], "left")
    return joined.select("word", "game_id", F.when(F.col("known").isNull(), "missing word").when(F.col("shown").isNull(), "no content").alias("reason"))


def audit_dictionary(words: DataFrame) -> DataFrame:
    """table, key, rule of words that are not lower case or hold white space."""
    rules = F.array(
        F.when(F.col("word") != F.lower("word"), "lower case"),
        F.when(F.col("word").rlike(r"\s"), "white space"),
        F.when(F.col("word").isNull(), "null word"),
    )
    return words.select(F.lit("dictionary").alias("table"), F.col("word").alias("key"), F.explode(F.array_compact(rules)).alias("rule"))


def audit_games(games: DataFrame) -> DataFrame:
    rules = F.array(
        F.when(F.lower("start_word") == F.lower("target_word"), "start is target"),
        F.when(F.size("all_fields") < 1, "no field"),
        F.when((F.col("start_word") != F.lower("start_word")) | (F.col("target_word") != F.lower("target_word")), "lower case"),
    )
    return games.select(F.lit("games").alias("table"), F.col("game_id").cast("string").alias("key"), F.explode(F.array_compact(rules)).alias("rule"))


def audit_edges(edges: DataFrame) -> DataFrame:
    """One row a broken rule, with the number of edges as key."""
    bad = F.when(F.col("target_pos").isNull(), "null tag").when(~F.col("target_pos").isin(POS_TAGS), "unknown tag").when(~F.col("edge_type").between(0, len(LEXICAL_KEYS) - 1), "unknown key")
    return edges.select(bad.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").cast("string").alias("key")).select(F.lit("edges").alias("table"), "key", "rule")
