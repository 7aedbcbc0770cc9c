"""Live races with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.races import race_aggregates
from ..sources.adapters import race_columns


def step_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Race steps from new event files under path."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return race_columns(events)


def live_race_state(steps: DataFrame) -> DataFrame:
    """Running found, link_count and duration_ms of each game and player; write in update or complete mode.

    State is a few aggregates a lane, not arrays; ties in time resolve by event id.
    """
    return race_aggregates(steps)


def upsert(state: DataFrame, path: str, log: str):
    """Writer of a stream in update mode: each batch adds the rows it changed as batch=<id> under path, again if it is repeated."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return state.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(write)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that ``upsert`` has written."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def validate_step_stream(steps: DataFrame, games: DataFrame, playable: DataFrame, delay: str = "1 hour") -> DataFrame:
    """steps (game, player, side, w, l, pos, ts, event_id) with the word played, accepted and reason, in append mode.

    Stream-static joins with the games' rules and playable (game, word) records. A repeated event_id counts once; steps older
    than the watermark by ``delay`` are dropped, and what is remembered of event ids expires with it.
    """
    once = steps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    rules = games.select("game", "available_pos", "lemmatise")
    joined = once.join(rules, "game", "left").withColumn("word", F.when(F.col("lemmatise"), F.col("l")).otherwise(F.col("w")))
    shown = playable.select("game", F.col("word").alias("low"), F.lit(True).alias("shown"))
    out = joined.withColumn("low", F.lower("word")).join(shown, ["game", "low"], "left")
    reason = F.when(F.col("available_pos").isNull(), "no game").when(~F.array_contains("available_pos", F.col("pos")), "tag not allowed").when(F.col("shown").isNull(), "not playable")
    return out.select("game", "player", "side", "word", "ts", "event_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def step_sinks(judged: DataFrame, path: str, log: str):
    """Writer of judged steps: accepted=true and accepted=false under path, each step in one of them exactly once."""
    return judged.writeStream.format("parquet").outputMode("append").partitionBy("accepted").option("path", path).option("checkpointLocation", log)
