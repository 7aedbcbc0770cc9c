"""The driver's tables as dictionary entries, links, vectors, races and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LEXICAL_KEYS, LINKAGES, POS_TAGS, key_name, pos_name

#: The fixed lists in SQL.
SQL_KEYS, SQL_TAGS = str(list(LEXICAL_KEYS)), str(list(POS_TAGS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English sentences of two tokens or more: doc_id, six, word (first token), rest (tokens), lexical_key.

    Tokens come out of the generator itself, so that what stands above never takes them from the text again.
    """
    tokens = F.transform(F.split("text", "[.]", -1), lambda s: F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.posexplode_outer(tokens).alias("six", "tokens"))
    return docs.where(F.size("tokens") >= 2).select(
        "doc_id", "six", F.get("tokens", F.lit(0)).alias("word"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("rest"),
        key_name(F.col("six") % len(LEXICAL_KEYS)).alias("lexical_key"),
    )


def entry_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a token: word (key), lexical_key, w, l, pos."""
    flat = entries(spark, sf_dir).select(F.lower("word").alias("word"), "lexical_key", F.explode_outer("rest").alias("w"))
    low = F.lower("w")
    lemma = F.when((F.length("w") > 3) & low.endswith("s"), F.expr("left(lower(w), length(w) - 1)")).otherwise(low)
    return flat.select("word", "lexical_key", "w", lemma.alias("l"), pos_name(F.length("w") % len(POS_TAGS)).alias("pos"))


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries, one a document: its first sentence's first token as word, its sentences as senses down to three levels.

    A sense has as many synonyms as its place modulo 4, an example at every fifth; entries have categories and empty derived
    terms by their doc_id. ord is the doc_id.
    """
    linked = "array<struct<word:string>>"
    no_links = F.lit(None).cast(linked)
    path = F.concat(F.array_repeat(F.lit("x"), F.col("six") % 3), F.array(F.concat_ws(" ", "rest")))
    synonyms = F.transform(F.slice("rest", F.lit(1), F.col("six") % 4), lambda w: F.struct(w.alias("word")))
    example = F.struct(F.get("rest", F.lit(0)).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("type"))
    sense = F.struct(
        path.alias("glosses"), F.when(F.col("six") % 5 == 0, F.array(example)).alias("examples"), F.lit(None).cast("array<array<string>>").alias("links"),
        *[(synonyms if k == "synonyms" else no_links).alias(k) for k in LINKAGES],
    )
    each = entries(spark, sf_dir).select("doc_id", F.struct("six", "word", sense.alias("sense")).alias("s"))
    docs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    word = F.get("s", F.lit(0))["word"]
    category = F.struct(F.lit("name").alias("kind"), word.alias("name"))
    own = [(F.when(F.col("doc_id") % 5 == 0, F.array().cast(linked)) if k == "derived" else no_links).alias(k) for k in LINKAGES]
    return docs.select(
        word.alias("word"), F.when(F.col("doc_id") % 2 == 0, "noun").otherwise("verb").alias("pos"), F.transform("s", lambda x: x["sense"]).alias("senses"), *own,
        F.when(F.col("doc_id") % 3 != 0, F.array(category)).alias("categories"), F.col("doc_id").alias("ord"),
    )


def race_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, player, side, word, ts_ms, event_id."""
    return race_columns(table(spark, sf_dir, "events"))


def race_columns(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 25).alias("game"), F.col("user_id").alias("player"),
        F.when(F.col("event_id") % 2 == 0, "start").otherwise("target").alias("side"),
        F.col("event_type").alias("word"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id",
    )


#: The same adapter in SQL, for oracles.
SQL_ENTRIES = f"""
sentences as (
  select doc_id, generate_subscripts(parts, 1) - 1 as six, unnest(parts) as sentence
  from (select doc_id, string_split(text, '.') as parts from documents where lang = 'en')
), entries as (
  select doc_id, six, tokens[1] as word, tokens[2:] as rest,
    ({SQL_KEYS})[six % 12 + 1] as lexical_key
  from (select doc_id, six, regexp_extract_all(sentence, '[A-Za-z]+') as tokens from sentences) where len(tokens) >= 2
)"""
SQL_TOKENS = (
    SQL_ENTRIES
    + f""", raw_tokens as (
  select lower(word) as word, lexical_key, unnest(rest) as w from entries
), tokens as (
  select word, lexical_key, w,
    case when length(w) > 3 and lower(w) like '%s' then lower(w)[1:length(w) - 1] else lower(w) end as l,
    ({SQL_TAGS})[length(w) % 18 + 1] as pos
  from raw_tokens
)"""
)
SQL_LINKS = (
    SQL_TOKENS
    + """, links as (
  select distinct word, 'w' as link_field, lexical_key, pos, w as target from tokens
  union select distinct word, 'l', lexical_key, pos, l from tokens
)"""
)
SQL_GRAPH = (
    SQL_LINKS
    + f""", nodes as (
  select row_number() over (order by word) - 1 as node_id, word from (select distinct word from tokens)
), edges as (
  select s.node_id as source_id, t.node_id as target_id,
    list_position({SQL_KEYS}, lexical_key) - 1 as edge_type,
    case when link_field = 'l' then 1 else 0 end as lemmatized, pos as target_pos
  from links join nodes s on s.word = links.word join nodes t on t.word = lower(links.target)
)"""
)
SQL_RAW = (
    SQL_ENTRIES
    + """, s as (
  select doc_id, six as ix, 1 + six % 3 as depth, rest, rest[1:six % 4] as syn, case when six % 5 = 0 then rest[1:1] end as ex from entries
), p as (
  select *, case depth when 2 then max(case when depth = 1 then ix end) over w when 3 then max(case when depth = 2 then ix end) over w end as parent_ix
  from s window w as (partition by doc_id order by ix rows between unbounded preceding and 1 preceding)
), o as (select *, row_number() over (partition by doc_id, parent_ix order by ix) - 1 as sib from p),
raw as (
  select doc_id, word, row_number() over (partition by word order by doc_id) - 1 as entry_ix
  from (select doc_id, lower(arg_min(word, six)) as word from entries group by doc_id)
), nodes as (
  select raw.word, raw.doc_id, entry_ix, concat_ws('.', c.sib, b.sib, a.sib) as path,
    case when b.ix is null then repeat('x ', cast(a.depth - 1 as bigint)) else '' end || array_to_string(a.rest, ' ') as gloss,
    case when b.ix is null then a.syn when len(a.syn) > len(b.syn) then a.syn[len(b.syn) + 1:] end as syn,
    case when b.ex is null then a.ex when len(a.ex) > len(b.ex) then a.ex[len(b.ex) + 1:] end as ex
  from o a join raw on raw.doc_id = a.doc_id left join o b on b.doc_id = a.doc_id and b.ix = a.parent_ix left join o c on c.doc_id = a.doc_id and c.ix = b.parent_ix
)"""
)
SQL_STEPS = """
steps as (
  select user_id % 25 as game, user_id as player, case when event_id % 2 = 0 then 'start' else 'target' end as side,
    event_type as word, epoch_us(ts) // 1000 as ts_ms, event_id from events
)"""
