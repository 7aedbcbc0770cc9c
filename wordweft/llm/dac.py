"""Token ids in directly addressable codes: encode, write, read any token without decoding its block.

An id is cut into chunks of 8 bits, low chunk first. Level 0 holds the low chunk of every id; a bitmap marks the ids
that go on, whose next chunks make up level 1, and so on. The place of id i in the next level is the number of set
bits before i, which a rank directory (set bits before each 64-bit word) gives in constant time.

A segment is one binary value::

    magic "DAC1", level count L as uint32, then for each level n as uint64, and for each level its n chunk bytes,
    padded to 8, the bitmap as ceil(n / 64) uint64 words and the rank directory as as many uint32 counts, padded.

Segments are rows of a Parquet table (segment's place, first token's offset, payload), so any store that Spark
writes holds them. ``read_documents`` reads whole documents back, ``read_tokens`` single tokens by their places.

Defined cases: null and empty texts give the end id alone; an empty table writes no segment; rows with equal doc_id
follow one another in the order of the table read; a null doc_id sorts first; texts may have any length, a document of
over SEGMENT_IDS ids is a segment of its own; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, collect_blobs, most_frequent, prepare, read_blobs, settle
from .lbl import word_counts

MAGIC = b"DAC1"
END_ID = 2
#: Ids of a segment at most, but for a longer single document, which is a segment of its own.
SEGMENT_IDS = 1 << 16
FREQUENT = 1 << 19
#: Bytes of text of a range of the exchange, on average.
RANGE_BYTES = 32 << 20
#: Share of the rows whose words are counted for the table of frequent ones.
COUNTED = 0.2
SEGMENT_COLUMNS = ["part", "segment", "first", "doc_ids", "counts", "payload"]


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def encode(ids: np.ndarray) -> bytes:
    rest = np.asarray(ids, dtype=np.uint32)
    levels, sizes = [], []
    while True:
        n = len(rest)
        more = rest >> np.uint32(8)
        on = more > 0
        bits = np.packbits(on, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % 8)
        words = np.frombuffer(bits, np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
        levels.append(_padded((rest & np.uint32(255)).astype(np.uint8).tobytes()) + bits + _padded(rank.tobytes()))
        sizes.append(n)
        rest = more[on]
        if not len(rest):
            break
    return MAGIC + np.uint32(len(levels)).tobytes() + np.array(sizes, np.uint64).tobytes() + b"".join(levels)


class Segment:
    """Read access to an encoded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        count = int(np.frombuffer(data, np.uint32, 1, 4)[0])
        sizes = np.frombuffer(data, np.uint64, count, 8).astype(np.int64)
        at = 8 + 8 * count
        self.levels = []
        for n in map(int, sizes):
            words = -(-n // 64)
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n + -n % 8
            bitmap = np.frombuffer(data, np.uint64, words, at)
            at += 8 * words
            rank = np.frombuffer(data, np.uint32, words, at)
            at += 4 * words + -(4 * words) % 8
            self.levels.append((chunk, bitmap, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Id number i: one step for each of its chunks."""
        value, shift = 0, 0
        for chunk, bitmap, rank in self.levels:
            value |= int(chunk[i]) << shift
            word, bit = int(bitmap[i >> 6]), i & 63
            if not word >> bit & 1:
                return value
            i = int(rank[i >> 6]) + (word & ((1 << bit) - 1)).bit_count()
            shift += 8
        raise ValueError("the last level goes on")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: each level's chunks are one run, found by its rank directory."""
        out = np.zeros(stop - start, np.uint32)
        at = np.arange(stop - start)
        for shift, (chunk, bitmap, rank) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * shift)
            w0, w1 = start >> 6, -(-stop // 64)
            on = np.unpackbits(bitmap[w0:w1].view(np.uint8), bitorder="little")[start - 64 * w0 : stop - 64 * w0].astype(bool)
            at = at[on]
            head = int(bitmap[w0]) & ((1 << (start & 63)) - 1)
            start = int(rank[w0]) + head.bit_count()
            stop = start + len(at)
        return out


@lru_cache(maxsize=2)
def _tokenizer(tokenizer_json: str, special_as_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.encode_special_tokens = special_as_text
    return tok


#: Letters before marks of ASCII, no apostrophe, at a word's end; nothing that is normalised or kept together spans the cut.
_TAIL = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.S)


def encode_words(tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after another, and each word's number of them."""
    found = [e.ids for k in range(0, len(words), 1024) for e in tok.encode_batch_fast(words[k : k + 1024], add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


class Lists:
    """Lists of ids one after another: those that stay, and after them those of the batch at hand."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes, self.starts = values.copy(), sizes.copy(), np.cumsum(sizes) - sizes
        self.count, self.total = len(sizes), len(values)

    def follow(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Put lists in the place of those that came last."""
        n, total = self.count + len(sizes), self.total + len(values)
        if n > len(self.sizes) or total > len(self.values):
            self.sizes, self.starts = [np.concatenate([x[: self.count], np.zeros(2 * len(sizes), np.int64)]) for x in (self.sizes, self.starts)]
            self.values = np.concatenate([self.values[: self.total], np.zeros(2 * len(values), np.uint32)])
        self.sizes[self.count : n], self.values[self.total : total] = sizes, values
        self.starts[self.count : n] = self.total + np.cumsum(sizes) - sizes

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists at place, one after another, and each list's size."""
        n = self.sizes[place]
        spots = np.repeat(self.starts[place] - np.cumsum(n) + n, n)
        spots += np.arange(len(spots))
        return self.values[spots], n


def text_encoder(tok, known: pa.Table | None):
    """Function from an array of texts to their ids, one after another, and the bounds of each text's.

    Words end at ASCII white space and are lower-cased in ASCII, but for texts that may hold a special token. Right for
    tokenizers whose tokens never cross white space and whose normaliser lower-cases and treats what lies between apart,
    as here: other white space stays inside a word, for the tokenizer to handle. known: word and ids of frequent words.
    Another word and its closing marks are looked up apart, and what is not known is encoded once a batch.
    """
    import pyarrow.compute as pc

    names = known["word"].combine_chunks() if known else pa.array([], pa.string())
    held = known["ids"].combine_chunks() if known else pa.array([], pa.binary())
    sizes = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    lists = Lists(np.frombuffer(b"".join(held.to_pylist()), np.uint32), sizes)
    index = WordIndex(names)
    del known, held, sizes

    def rare_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [m.groups() if "<|" not in w and (m := _TAIL.fullmatch(w)) else (w,) for w in words]
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(x, len(place)) for p in parts for x in p), np.int64)
        each = pa.array(list(place), pa.string())
        spot = index.places(each)
        new = spot < 0
        lists.follow(*encode_words(tok, each.filter(pa.array(new)).to_pylist()))
        spot[new] = len(names) + np.arange(int(new.sum()))
        ids, n = lists.gather(spot[at])
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)])]
        return ids, np.diff(bounds)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        flat = split.flatten().dictionary_encode()
        spot = index.places(flat.dictionary)
        new = spot < 0
        lists.follow(*rare_words(flat.dictionary.filter(pa.array(new)).to_pylist()))
        spot[new] = len(names) + np.arange(int(new.sum()))
        place = spot[flat.indices.to_numpy(zero_copy_only=False)]
        del flat
        ids, n = lists.gather(place)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])]

    return run


def write_segments(
    docs: DataFrame, path: str, tokenizer_json: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, frequent: int = FREQUENT,
    range_bytes: int = RANGE_BYTES, special_as_text: bool = False,
) -> None:
    """Encode docs in ascending doc_id order and write their segments to path.

    Frequent words, ``frequent`` at most, are encoded once and broadcast; they are counted in a share of the rows, since
    they save work and change nothing else. Rows are exchanged once, by ranges of (doc_id, row), so that a doc_id of many
    rows is dealt to several ranges; each range encodes its texts and writes its segments. special_as_text: names of
    special tokens in a text are plain text.
    """
    spark = prepare(docs.sparkSession)
    shared_json = spark.sparkContext.broadcast(tokenizer_json)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared_json.value, special_as_text)
        for batch in batches:
            ids, sizes = encode_words(tok, batch.column(0).to_pylist())
            data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            own = [data[i:j] for i, j in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["word", "ids"])

    top, _ = most_frequent(settle(word_counts(docs.select("text").sample(COUNTED, seed=5)), "words"), frequent)
    spread = top.select(F.col("word").cast("string").alias("word")).repartition(2 * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(collect_blobs(spread.mapInArrow(words, "word string, ids binary")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = text_encoder(_tokenizer(shared_json.value, special_as_text), read_blobs(shared.value))
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()

        def flush() -> pa.RecordBatch:
            row = part, number, first, names, [len(x) for x in held], encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], SEGMENT_COLUMNS)

        for batch in batches:
            ids, bounds = run(batch.column(1))
            bounds = bounds.tolist()
            for doc, i, j in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                if held and size + j - i + 1 > segment_ids:
                    yield flush()
                    number, first, size, held, names = number + 1, first + size, 0, [], []
                held.append(np.append(ids[i:j], np.uint32(end_id)))
                names.append(doc)
                size += j - i + 1
            del ids
            pa.default_memory_pool().release_unused()
        if held:
            yield flush()

    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(count, F.asc_nulls_first("doc_id"), "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "row")
    packed = ranged.select("doc_id", "text").mapInArrow(
        pack, "part int, segment int, first long, doc_ids array<long>, counts array<long>, payload binary"
    )
    packed.write.parquet(path)


def _parts(files: DataFrame) -> list[tuple[int, int]]:
    """Part and its first token's place, in order: one pair for each range of the exchange."""
    sizes = files.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    total, out = 0, []
    for row in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        out.append((row["part"], total))
        total += row["n"]
    return out


def read_tokens(spark, path: str, places: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """place, token_id for rows of place, a token's number in the whole table from 0; none for places beyond it.

    A place meets its segment by the stretches of segment_ids tokens that the segment touches; of a segment, only the
    chunks of the asked tokens are looked at.
    """
    prepare(spark)
    files = spark.read.parquet(path)
    base = spark.createDataFrame(_parts(files), "part int, base long")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    index = files.select("part", "segment", "first", size.alias("n")).join(base, "part").select("part", "segment", (F.col("base") + F.col("first")).alias("start"), "n")
    stretch = F.explode(F.sequence(F.floor(F.col("start") / segment_ids), F.floor((F.col("start") + F.col("n") - 1) / segment_ids)))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("stretch", F.floor(F.col("place") / segment_ids))
    met = asked.join(index.withColumn("stretch", stretch), "stretch").where("place >= start and place < start + n")
    found = met.select("part", "segment", "place", (F.col("place") - F.col("start")).alias("at")).join(files.select("part", "segment", "payload"), ["part", "segment"])

    def get(payloads: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([Segment(p)[i] for p, i in zip(payloads, at)], dtype="int64")

    return found.select("place", F.pandas_udf(get, "long")("payload", "at").alias("token_id"))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments under path alone."""
    prepare(spark)
    files = spark.read.parquet(path)
    base = dict(_parts(files))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, ids, counts, payload in zip(*(c.to_pylist() for c in batch.columns)):
                segment = Segment(payload)
                ends = np.cumsum(counts)
                crcs = [crc32(segment.slice(int(e - n), int(e)).astype("<u4").tobytes()) for e, n in zip(ends, counts)]
                start = base[part] + first + ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "first", "doc_ids", "counts", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
