"""Race histories: lanes, stats, step times, validation, hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import available_pos
from ..functions.scalars import finish_summary, hint_category, race_stats, step_time_label
from .dictionary import check_records

LANE = ["game", "player", "side"]


def step_times(steps: DataFrame) -> DataFrame:
    """steps with ms since the lane's step before (null for the first) and its label."""
    before = F.lag("ts_ms").over(Window.partitionBy(*LANE).orderBy("ts_ms", "event_id"))
    return steps.withColumn("ms", F.col("ts_ms") - before).withColumn("label", step_time_label(F.col("ms")))


def lanes(steps: DataFrame) -> DataFrame:
    """game, player, start_links, target_links: ordered (word, timestamp) arrays."""
    step = F.struct(F.col("ts_ms").alias("timestamp"), "event_id", "word")

    def lane(side: str):
        ordered = F.array_sort(F.collect_list(F.when(F.col("side") == side, step)))
        return F.transform(ordered, lambda x: F.struct(x["word"].alias("word"), x["timestamp"].alias("timestamp"))).alias(f"{side}_links")

    return steps.groupBy("game", "player").agg(lane("start"), lane("target"))


def race_table(steps: DataFrame) -> DataFrame:
    """game, player, found, link_count, duration_ms from lanes."""
    return lanes(steps).select("game", "player", *race_stats(F.col("start_links"), F.col("target_links")))


def race_aggregates(steps: DataFrame) -> DataFrame:
    """The same without arrays: first and last step and count of each lane, then the two lanes side by side."""
    def of(side: str, what):
        return F.when(F.col("side") == side, what)

    order = F.struct("ts_ms", "event_id")
    ends = steps.groupBy("game", "player").agg(
        *[F.max_by(F.col("word"), of(s, order)).alias(f"{s}_word") for s in ("start", "target")],
        *[F.count(of(s, F.lit(1))).alias(f"{s}_n") for s in ("start", "target")],
        *[(F.max(of(s, F.col("ts_ms"))) - F.min(of(s, F.col("ts_ms")))).alias(f"{s}_ms") for s in ("start", "target")],
    )
    return ends.select(
        "game", "player", (F.col("start_word") == F.col("target_word")).alias("found"),
        (F.col("start_n") + F.col("target_n") - 2).alias("link_count"), F.greatest("start_ms", "target_ms").alias("duration_ms"),
    )


def summaries(races: DataFrame, modes: DataFrame) -> DataFrame:
    return races.join(modes, "game").select("game", "player", *finish_summary(F.col("mode"), F.col("link_count"), F.col("duration_ms")))


def games_with_players(games: DataFrame, links: DataFrame, players: DataFrame) -> DataFrame:
    return games.join(links, "game").join(players, "player")


def initial_lanes(joins: DataFrame, games: DataFrame) -> DataFrame:
    """game, player, start_links, target_links: each lane holds its endpoint at the time of joining."""
    def lane(word: str):
        return F.array(F.struct(F.col(word).alias("word"), F.col("joined_ms").alias("timestamp")))

    return joins.join(games, "game").select("game", "player", lane("start_word").alias("start_links"), lane("target_word").alias("target_links"))


def clickable_tokens(tokens: DataFrame, games: DataFrame) -> DataFrame:
    """Tokens (not literals) of a tag the game allows: rows of tokens with game."""
    allowed = games.select("game", F.explode("available_pos").alias("pos"))
    return tokens.where("w is not null").join(allowed, "pos")


def with_mode_tags(games: DataFrame) -> DataFrame:
    return games.withColumn("available_pos", available_pos(F.col("mode")))


def judge_steps(steps: DataFrame, games: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """steps (game, player, side, w, l, pos, ts_ms, event_id) with the word played and reason (null: accepted)."""
    rules = games.select("game", "available_pos", "lemmatise")
    joined = steps.join(rules, "game", "left").withColumn("word", F.when(F.col("lemmatise"), F.col("l")).otherwise(F.col("w")))
    records = check_records(joined.select("word", F.col("game").alias("game_id")), words, fields, games.withColumnRenamed("game", "game_id"))
    records = records.select(F.col("word").alias("low"), F.col("game_id").alias("game"), F.col("reason").alias("record"))
    out = joined.withColumn("low", F.lower("word")).join(records, ["game", "low"], "left")
    reason = F.when(F.col("available_pos").isNull(), "no game").when(~F.array_contains("available_pos", F.col("pos")), "tag not allowed").otherwise(F.col("record"))
    return out.select("game", "player", "side", "word", "ts_ms", "event_id", reason.alias("reason"))


def apply_steps(steps: DataFrame, games: DataFrame, words: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lanes of accepted steps, rejected steps with reason)."""
    judged = judge_steps(steps, games, words, fields)
    return lanes(judged.where("reason is null")), judged.where("reason is not null")


def validate_games(games: DataFrame, tokens: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """game, reason (null: playable). tokens: game, side, w, l, pos of each endpoint's first token."""
    start = tokens.where("side = 'start'").select("game", F.col("w").alias("sw"), F.col("l").alias("sl"), F.col("pos").alias("sp"))
    target = tokens.where("side = 'target'").select("game", F.col("w").alias("tw"), F.col("l").alias("tl"), F.col("pos").alias("tp"))
    known = games.join(start, "game", "left").join(target, "game", "left")
    pick = lambda s: F.lower(F.when(F.col("lemmatise"), F.col(f"{s}l")).otherwise(F.col(f"{s}w")))
    known = known.withColumn("s", pick("s")).withColumn("t", pick("t"))
    pairs = known.select(F.col("s").alias("word"), F.col("game").alias("game_id")).unionByName(known.select(F.col("t").alias("word"), F.col("game").alias("game_id"))).where("word is not null")
    bad = check_records(pairs, words, fields, games.withColumnRenamed("game", "game_id")).where("reason is not null")
    bad = bad.groupBy(F.col("game_id").alias("game")).agg(F.min("reason").alias("record"))
    reason = (
        F.when(F.size("all_fields") < 1, "no field")
        .when(F.col("s").isNull() | F.col("t").isNull(), "endpoint is no word")
        .when(F.col("s") == F.col("t"), "start is target")
        .when(~F.array_contains("available_pos", F.col("sp")) | ~F.array_contains("available_pos", F.col("tp")), "tag not allowed")
        .otherwise(F.col("record"))
    )
    return known.join(bad, "game", "left").select("game", reason.alias("reason"))


def route_hints(routes: DataFrame) -> DataFrame:
    """query_id, steps, category from paths: the start lane's links, or both lanes' in collide games."""
    return routes.select("query_id", F.col("links").alias("steps"), hint_category(F.col("links")).alias("category"))
