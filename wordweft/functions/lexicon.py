"""Fixed values of the data model and the small tables and masks made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lexical keys in id order, token tags in id order, tags that collide games leave out.
LEXICAL_KEYS = [
    "antonyms", "synonyms", "hypernyms", "hyponyms", "holonyms", "meronyms",
    "derived", "related", "coordinate_terms", "glosses", "examples", "categories",
]
POS_TAGS = [
    "ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM",
    "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X", "SPACE",
]
COLLIDE_LEFT_OUT = ["ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ"]

LINKAGES = LEXICAL_KEYS[:9]
ENTRY_KEYS = [*LINKAGES, "categories"]
SENSE_KEYS = [*LINKAGES, "glosses", "examples"]
#: Printable sub-field of each object-array key.
PRINTABLE = {k: "word" for k in LINKAGES} | {"examples": "text", "categories": "name"}
ALL_FIELDS, ALL_POS = (1 << len(LEXICAL_KEYS)) - 1, (1 << len(POS_TAGS)) - 1


def field_mask(keys: list[str]) -> int:
    return sum(1 << LEXICAL_KEYS.index(k) for k in set(keys))


def pos_mask(tags: list[str]) -> int:
    return sum(1 << POS_TAGS.index(t) for t in set(tags))


COLLIDE_POS = ALL_POS ^ pos_mask(COLLIDE_LEFT_OUT)


def key_table(spark: SparkSession) -> DataFrame:
    """lexical_key, edge_type: the 12 keys and their ids."""
    return spark.createDataFrame([(k, i) for i, k in enumerate(LEXICAL_KEYS)], "lexical_key string, edge_type int")


def key_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEXICAL_KEYS)), number.cast("int") + 1)


def pos_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POS_TAGS)), number.cast("int") + 1)


def pos_id(tag: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, POS_TAGS)), tag).cast("int") - 1


def available_pos(mode: Column) -> Column:
    """Sorted tags a game of this mode allows; an unknown mode allows none."""
    everything = F.array(*map(F.lit, sorted(POS_TAGS)))
    some = F.array(*map(F.lit, sorted(set(POS_TAGS) - set(COLLIDE_LEFT_OUT))))
    none = F.array().cast("array<string>")
    return F.when(mode == "normal", everything).when(mode == "collide", some).otherwise(none)


def has_bit(mask: Column, bit: Column) -> Column:
    return F.getbit(mask.cast("long"), bit.cast("int")) == 1
