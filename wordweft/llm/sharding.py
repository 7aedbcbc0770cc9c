"""Shards of near-equal bytes by a histogram sort.

Rows get a 64-bit key: the high half is a hash of the text, the low half one of the row's id and place, so equal texts lie
side by side and only a boundary that must fall inside such a group splits it, between any two of its rows. Splitters are
found by rounds: count the exact bytes below candidate boundaries in every partition, sum them, and probe again inside the
interval that still holds each target, until every splitter meets the tolerance or no key lies between its bounds. Then
the rows are exchanged once, by ranges of the key as many as the bytes ask for, and numbered as they lie. The driver sees
only counts for the probes, whose number depends on the shards alone.

Defined cases: a null text has size ``overhead`` and CRC 0; null and repeated ids are placed like others; equal rows may
stand in any order but get slots of their own, and a shard boundary may part them; fewer rows than shards leave shards
empty; texts may have any length, a row is never cut; extra columns travel along, and columns whose names clash with the
results' are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle

OVERHEAD = 16
#: Bytes of a key range of the exchange, on average.
RANGE_BYTES = 64 << 20
OWN = ["size", "law", "shard", "slot", "grown_shard"]
_SIGN = np.uint64(1 << 63)


def size_of(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def key_of(text: Column, *row: Column) -> Column:
    """Sort key as a signed long: text hash above, hash of what tells the row from others below."""
    high = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32)))
    low = F.xxhash64(*row, F.lit("row")).bitwiseAND(F.lit((1 << 32) - 1))
    return high.bitwiseOR(low)


def _below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of keys smaller than each (sorted, signed) probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(probes) + 1, np.int64)
        rows = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(size), pa.array(rows)], ["slice", "size", "rows"])

    found = keys.select("key", "size").mapInArrow(count, "slice long, size long, rows long")
    total = found.groupBy("slice").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    size[total["slice"]], rows[total["slice"]] = total["size"], total["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, shards: int, tolerance: float = 1e-3, fan: int = 24, max_rounds: int = 40) -> list[int]:
    """shards - 1 ascending boundaries; shard k holds the keys from boundary k - 1 up to, not with, boundary k."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    goal = np.array([total * k / shards for k in range(1, shards)])
    slack = tolerance * total / shards
    low = [0] * (shards - 1)  # unsigned keys; bytes below low are at most the goal
    high = [1 << 64] * (shards - 1)
    low_bytes, high_bytes = np.zeros(shards - 1), np.full(shards - 1, float(total))
    best, best_gap = list(low), np.abs(goal)
    for _ in range(max_rounds):
        asked: set[int] = set()
        for k in range(shards - 1):
            if best_gap[k] <= slack or high[k] - low[k] <= 1:
                continue
            span = high[k] - low[k]
            weight = (goal[k] - low_bytes[k]) / max(high_bytes[k] - low_bytes[k], 1)
            asked.update(low[k] + span * j // (fan + 1) for j in range(1, fan + 1))
            asked.update(int(low[k] + span * min(max(weight + d, 0.0), 1.0)) for d in (-1e-3, 0.0, 1e-3))
        asked = {p for p in asked if 0 < p < 1 << 64}
        if not asked:
            break
        order = sorted(asked)
        signed = (np.array(order, dtype=np.uint64) ^ _SIGN).view(np.int64)
        below, _ = _below(keys, signed)
        for k in range(shards - 1):
            if best_gap[k] <= slack:
                continue
            gap = np.abs(below - goal[k])
            i = int(gap.argmin())
            if gap[i] < best_gap[k]:
                best[k], best_gap[k] = order[i], gap[i]
            at = int(np.searchsorted(below, goal[k], side="right"))
            if at > 0 and order[at - 1] > low[k]:
                low[k], low_bytes[k] = order[at - 1], below[at - 1]
            if at < len(order) and order[at] < high[k]:
                high[k], high_bytes[k] = order[at], below[at]
    best = np.maximum.accumulate(np.array(best, dtype=np.uint64))
    return [int(x) for x in (best ^ _SIGN).view(np.int64)]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 1e-3, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard.

    Rows are exchanged by key ranges of about range_bytes, each sorted apart; a slot is a row's place in its range after
    the shard's rows in the ranges before it, so no task holds a whole shard.
    """
    spark = prepare(docs.sparkSession)
    text, ident = F.col("text"), F.col("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in OWN]).alias("row")
    kept = docs.select(row, size_of(text).alias("size"), key_of(text, ident, F.monotonically_increasing_id()).alias("key"))
    keys = settle(kept.select("key", "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = F.array(*map(F.lit, splitters(keys, shards, tolerance))).cast("array<bigint>")
    number = F.size(F.filter(cuts, lambda c: c <= F.col("key"))).alias("shard")
    count = max(shards, 2 * spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    sorted_ = kept.repartitionByRange(count, "key").sortWithinPartitions("key")
    dealt = settle(sorted_.select("row", "size", number, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "dealt")
    # A row for each range, and one more for each shard boundary: as many as partitions.
    stretches = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    placed = dealt.join(F.broadcast(stretches.select("shard", "part", (before - F.col("first")).alias("shift"))), ["shard", "part"])
    return placed.select(
        "row.*",
        "size",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The sharded rows as Parquet under path/shard=N; slot gives their order."""
    shard(docs, shards).write.partitionBy("shard").parquet(path)
