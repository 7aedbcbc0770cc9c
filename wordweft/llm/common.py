"""Shared helpers of the corpus operators: shared-folder tables, session limits, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import settle, shared_dir

__all__ = ["Filter", "WordIndex", "bind", "collect_blobs", "components", "crc_of_id", "filter_words", "may_hold", "most_frequent", "prepare", "read_blobs", "settle", "shared_dir"]

#: Rows and bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2048, "3m"
#: Bits of a Bloom filter for each hash, and at most; hashes are probed so many times.
SEED_BITS, FILTER_BITS, PROBES = 256, 1 << 28, 4


def prepare(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> SparkSession:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    return spark


def bind(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def most_frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """counts (with n) in two: the most frequent rows, at most limit, and the rest.

    The cut lies between classes of counts, sixteen to an octave, so that the driver sees a thousand numbers at
    most and nothing is sorted; rows of one class stay together.
    """
    grade = F.floor(16 * F.log2(F.col("n").cast("double")))
    sizes = counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("rows")).orderBy(F.desc("grade")).collect()
    held, cut = 0, None
    for row in sizes:
        if held + row["rows"] > limit:
            break
        held, cut = held + row["rows"], row["grade"]
    if cut is None:
        return counts.where(F.lit(False)), counts
    return counts.where(grade >= cut), counts.where(grade < cut)


def collect_blobs(df: DataFrame) -> list[bytes]:
    """A table of bounded size as Arrow streams, one for each task: on the driver bytes, not a Python object a row."""
    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob"])

    return [bytes(r["blob"]) for r in df.mapInArrow(pack, "blob binary").collect()]


def read_blobs(blobs: list[bytes]):
    """The Arrow table of ``collect_blobs``, or None if it is empty."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
    return pa.concat_tables(tables).combine_chunks() if tables else None


class WordIndex:
    """Places of words in an array of names: sorted hashes, and a comparison of what they lead to."""
    def __init__(self, names):
        self.names = names
        hashes = self._hashes(names)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hashes(words):
        # A slice at a time, since strings become objects for as long as they are hashed.
        slices = (words.slice(k, 1 << 16).to_numpy(zero_copy_only=False) for k in range(0, len(words), 1 << 16))
        return np.concatenate([np.zeros(0, np.uint64), *(pd.util.hash_array(x, categorize=False) for x in slices)])

    def places(self, words):
        """Place of each of an array's words, -1 for others; of names with the same hash one is found."""
        if not len(self.names) or not len(words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, self._hashes(words)), len(self.hashes) - 1)
        found = self.order[at].astype(np.int64)
        same = pc.equal(self.names.take(pa.array(found)), words).to_numpy(zero_copy_only=False)
        return np.where(same, found, -1)


class Filter:
    """Bloom filter of 64-bit hashes, from the words of ``filter_words``."""
    def __init__(self, words):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def keep(self, hashes):
        """Those hashes that may be in the filter."""
        for k in range(PROBES):
            at = (hashes >> np.uint64(8 * k)) & self.mask
            hashes = hashes[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return hashes


def filter_words(table: DataFrame, each: int = SEED_BITS):
    """The bits of a filter of the column seed as 64-bit words, at most FILTER_BITS // 64 of them, ``each`` bits a seed."""
    count = table.select("seed").distinct().count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (each * count).bit_length()))
    place = [F.shiftrightunsigned("seed", 8 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]
    places = table.select(F.explode(F.array(*place)).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = read_blobs(collect_blobs(found))
    words = np.zeros(bits // 64, np.int64)
    if rows:
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


def may_hold(value: Column, spark: SparkSession, words) -> Column:
    """Whether the filter, of xxhash64 of values, may hold a value."""
    shared = spark.sparkContext.broadcast(words)

    def of(hashes: pd.Series) -> pd.Series:
        found = hashes.to_numpy().view(np.uint64)
        return pd.Series(np.isin(found, Filter(shared.value).keep(found)))

    return F.pandas_udf(of, "boolean")(F.xxhash64(value))


def crc_of_id(doc_id: Column | str) -> Column:
    """Unsigned CRC-32 of the id's decimal text (null id: of the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star rounds.

    Returns (node, root) for every node that has an edge; root is the least node of its component.
    Each round is two aggregations and joins on node ids; nothing is collected but a row count and a
    checksum, and each round's edges are written to the shared folder.
    """
    now = settle(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges"
    )
    before = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = (
            joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionByName(least.select(F.col("m").alias("lo"), "hi"))
            .where("lo < hi")
            .distinct()
        )
        now = settle(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
