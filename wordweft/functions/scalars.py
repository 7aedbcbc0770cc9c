"""Column functions on races, paths, vectors and gloss fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import LEXICAL_KEYS, POS_TAGS


def norm_word(word: Column) -> Column:
    """Dictionary key of a word."""
    return F.lower(word)


def step_time_label(ms: Column) -> Column:
    """Time of a step: seconds and floored tenths below a minute, else minutes and seconds; null is the first step."""
    seconds = F.floor(ms / 1000)
    short = F.concat(seconds.cast("string"), F.lit("."), F.floor((ms % 1000) / 100).cast("string"), F.lit("s"))
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(ms.isNull(), "Start").when(ms < 60000, short).otherwise(long)


def hint_category(steps: Column) -> Column:
    return (
        F.when(steps.isNull(), "No route").when(steps <= 2, "Hot").when(steps <= 4, "Warm").when(steps <= 7, "Cool").otherwise("Cold")
    )


def race_stats(start_links: Column, target_links: Column) -> list[Column]:
    """found, link_count and duration_ms of two arrays of (word, timestamp) steps."""

    def last(a: Column, field: str) -> Column:
        return F.try_element_at(a, F.lit(-1))[field]

    def spent(a: Column) -> Column:
        return last(a, "timestamp") - F.try_element_at(a, F.lit(1))["timestamp"]

    return [
        (last(start_links, "word") == last(target_links, "word")).alias("found"),
        (F.size(start_links) + F.size(target_links) - 2).cast("long").alias("link_count"),
        F.greatest(spent(start_links), spent(target_links)).alias("duration_ms"),
    ]


def finish_summary(mode: Column, link_count: Column, duration_ms: Column) -> list[Column]:
    return [
        F.floor(duration_ms / 1000).alias("seconds"),
        link_count.alias("links"),
        F.when(mode == "collide", "collided").otherwise("reached").alias("outcome"),
    ]


def path_links(mode: Column, start_path: Column, target_path: Column, target: Column) -> list[Column]:
    """Links of each lane, their sum and whether the paths end as the mode asks."""

    def count(path: Column) -> Column:
        return F.when(path.isNotNull() & (F.size(path) > 0), F.size(path) - 1)

    def end(path: Column) -> Column:
        return F.try_element_at(path, F.lit(-1))

    collide = mode == "collide"
    return [
        count(start_path).alias("start_links"),
        F.when(collide, count(target_path)).alias("target_links"),
        F.when(collide, count(start_path) + count(target_path)).otherwise(count(start_path)).alias("combined_links"),
        F.coalesce(F.when(collide, end(start_path) == end(target_path)).otherwise(end(start_path) == F.lower(target)), F.lit(False)).alias("valid"),
    ]


def optimality(exact: Column, found: Column) -> Column:
    return F.when((exact == 0) & (found == 0), 1.0).when(exact.isNotNull() & (found > 0), exact / found)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def neg_euclidean(a: Column, b: Column) -> Column:
    return -euclidean(a, b)


def pair_interactions(current: Column, target: Column) -> Column:
    """Differences, products, cosine, distance and dot product: 2 d + 3 values."""
    apart = F.zip_with(target, current, lambda t, c: t.cast("double") - c.cast("double"))
    times = F.zip_with(current, target, lambda c, t: c.cast("double") * t.cast("double"))
    return F.concat(apart, times, F.array(cosine_similarity(current, target), euclidean(current, target), dot(current, target)))


def dense_mask(present: Column, keys: list[str]) -> Column:
    """1.0 or 0.0 for each key, in order."""
    return F.transform(F.array(*map(F.lit, keys)), lambda k: F.array_contains(present, k).cast("double"))


def bits(mask: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.getbit(mask.cast("long"), i).cast("double"))


def cost_features(current: Column, target: Column, lemmatized: Column, fields: Column, tags: Column) -> Column:
    """Both vectors, their interactions, the link mode and both masks: 4 d + 34 values."""

    def wide(a: Column) -> Column:
        return F.transform(a, lambda x: x.cast("double"))

    return F.concat(
        wide(current), wide(target), pair_interactions(current, target),
        F.array(lemmatized.cast("int").cast("double")), bits(fields, len(LEXICAL_KEYS)), bits(tags, len(POS_TAGS)),
    )


def gloss_remainder(glosses: Column, parent_length: Column) -> Column:
    return F.when(glosses.isNotNull(), F.array_join(F.slice(glosses, parent_length + 1, F.size(glosses)), " "))


def field_diff(values: Column, parent_values: Column) -> Column:
    """What a sense adds after as many values as its parent has; null if nothing."""
    rest = F.slice(values, F.coalesce(F.size(parent_values), F.lit(0)) + 1, F.size(values))
    return F.when(parent_values.isNull(), values).when(F.size(rest) > 0, rest)


def sense_depth(glosses: Column) -> Column:
    """Length of the gloss path; 1 without one; 0 marks an empty path, which rejects the word."""
    return F.when(glosses.isNull(), 1).otherwise(F.size(glosses))


def present_fields(present: Column) -> Column:
    return F.filter(F.array(*map(F.lit, LEXICAL_KEYS)), lambda k: F.array_contains(present, k))


def learned_score(cost: Column, logit: Column, penalty: float) -> Column:
    return F.greatest(cost, F.lit(0.0)) + penalty / (1 + F.exp(logit))


def setlike_to_array(column: Column) -> Column:
    return F.array_sort(F.map_keys(column))


def array_to_setlike(column: Column) -> Column:
    return F.map_from_arrays(F.array_distinct(column), F.transform(F.array_distinct(column), lambda _: F.lit(True)))


def game_field_sets(entry_only: Column, sense_only: Column, shared: Column) -> list[Column]:
    """Sorted arrays: sense fields, entry fields and all fields; the last two are one union."""
    everything = F.array_sort(F.array_union(F.array_union(entry_only, sense_only), shared))
    return [
        F.array_sort(F.array_union(sense_only, shared)).alias("sense_fields"),
        everything.alias("entry_fields"),
        everything.alias("all_fields"),
    ]


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def pool_normalize(vectors: Column, mask: Column, method: str = "mean") -> Column:
    """Mean of the masked token vectors, or the first one, at unit length."""
    if method == "cls":
        pooled = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    else:
        weight = F.greatest(_total(mask), F.lit(1e-9))
        width = F.size(F.get(vectors, F.lit(0)))
        pooled = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: _total(F.zip_with(vectors, mask, lambda v, m: F.get(v, i).cast("double") * m.cast("double"))) / weight,
        )
    return F.get(F.transform(F.array(pooled), lambda p: F.transform(p, lambda x: x / F.greatest(norm(p), F.lit(1e-9)))), F.lit(0))
