"""Byte-level BPE with Spark's higher-order functions: encode, decode.

Text is cut into words by the tokenizer's pattern, distinct words are counted, and folds of ranked merges turn words into
ids. The rank map is one row: pieces and ranks in slots that a hash without collisions gives, so that a lookup is one
comparison whatever the vocabulary's size. Plans get it as a scalar subquery, not as a literal: the driver writes plans out
as text, literals and all, several times a query.

* Words of up to SHORT bytes: the fold's state is the pieces, each a number made of its rank with the next piece, its
  place and its id, so that the least number is the leftmost pair of the least rank. A step merges it and looks up the two
  pairs that this makes.
* Longer words, where such a step would copy many pieces: the fold goes over the word's candidates, which are all runs of
  its bytes that are pieces, in the order of rank, then place. Its state are the marks of the pieces' bounds, a byte each;
  a candidate that now is exactly two pieces becomes one. ``check_order`` makes sure that this gives the same merges.

The ``frequent`` most frequent words are folded once and broadcast, a table of so many rows at most. Other words are
folded once for each batch of documents that has them: they seldom come twice, and handing their ids back to the
documents would exchange the documents' codes, too.

Defined cases: null and empty texts have no token and the digest of nothing; a null doc_id is kept; equal rows are
encoded apart; special tokens' names are plain text; words may have any length; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, bind, collect_blobs, most_frequent, prepare, read_blobs, settle

FREQUENT = 1 << 19
SHORT = 64
#: A piece's number in the fold of short words: rank with the next piece, place, id. No pair has the rank NO_RANK, which
#: as an id stands for a byte that was never merged.
PLACE_BITS, ID_BITS, NO_RANK = 8, 22, (1 << 22) - 1
#: A candidate's number in the fold of long words: rank, place, length.
LENGTH_BITS, START_BITS = 8, 32
#: Slots of the table of piece lengths by the first three bytes.
STARTS = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of a base64 piece and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode's own classes, as Java's regular expressions take it."""
    return "(?U)" + pattern


def place_keys(keys: list[bytes]) -> tuple[list[int], list[int], int, int]:
    """A slot of its own for each key, the moves of the buckets, the number of slots and the shift of the hash.

    A key's slot is the low bits of its shifted hash, moved by the number of the bucket that higher bits choose.
    """
    slots = 1 << max(4, (len(keys) * 5 // 4).bit_length())
    buckets = slots >> 2
    hashes = [xxhash.xxh64_intdigest(k, 42) for k in keys]
    for shift in range(20):
        held: list[list[int]] = [[] for _ in range(buckets)]
        for k, h in enumerate(hashes):
            held[h >> 44 & buckets - 1].append(k)
        place, moves, taken = [0] * len(keys), [0] * buckets, bytearray(slots)
        for bucket in sorted(range(buckets), key=lambda b: -len(held[b])):
            own = [hashes[k] >> shift & slots - 1 for k in held[bucket]]
            move = next((d for d in range(slots) if not any(taken[x ^ d] for x in own)), None)
            if len({*own}) < len(own) or move is None:
                break
            moves[bucket] = move
            for k, x in zip(held[bucket], own):
                place[k] = x ^ move
                taken[x ^ move] = 1
        else:
            return place, moves, slots, shift
    raise ValueError("no placing of the keys without collisions")


class RankMap:
    """The rank map as a struct: names and ranks of pieces by slot, and lengths of pieces by their start."""

    KIND = "struct<names:array<binary>,ranks:array<bigint>,moves:array<int>,starts:array<int>,sets:array<array<int>>,twos:array<bigint>>"

    def __init__(self, ranks: dict[bytes, int]):
        check_order(ranks)
        pieces = list(ranks)
        if max(ranks.values()) >= NO_RANK or max(map(len, pieces)) >= 1 << LENGTH_BITS:
            raise ValueError("ids or pieces are too large for a candidate's number")
        place, moves, self.slots, self.shift = place_keys(pieces)
        self.buckets = len(moves)
        names: list[str | None] = [None] * self.slots
        numbers: list[int | None] = [None] * self.slots
        for piece, at in zip(pieces, place):
            names[at], numbers[at] = base64.b64encode(piece).decode(), ranks[piece]
        # By the CRC of three bytes, the number of a set: the lengths of pieces with this start.
        starts = [{2} for _ in range(STARTS)]
        for piece in pieces:
            if len(piece) > 2:
                starts[zlib.crc32(piece[:3]) % STARTS].add(len(piece))
        sets: dict[tuple[int, ...], int] = {}
        by_start = [sets.setdefault(tuple(sorted(x)), len(sets)) for x in starts]
        #: Pieces that merges of their bytes don't lead to, and their ids.
        self.apart = [(p, ranks[p]) for p in pieces if len(_bounds(p, ranks)) > 2]
        # Ranks of two bytes, by bits of their CRC that tell all of them apart.
        both = [bytes([a, b]) for a in range(256) for b in range(256)]
        self.window = next(s for s in range(17) if len({zlib.crc32(x) >> s & 65535 for x in both}) == 65536)
        twos: list[int | None] = [None] * 65536
        for x in both:
            twos[zlib.crc32(x) >> self.window & 65535] = ranks.get(x)
        row = {"names": names, "ranks": numbers, "moves": moves, "starts": by_start, "sets": list(sets), "twos": twos}
        self.json = json.dumps(row)

    @property
    def literal(self) -> Column:
        """The map as a literal, for an expression that stands alone: plans are written out with the whole of it."""
        return F.from_json(F.lit(self.json), self.KIND)

    def beside(self, df: DataFrame, name: str) -> DataFrame:
        """df with the map as a further column, which plans name only; to be used once, so that no row has a copy."""
        one = df.sparkSession.createDataFrame([(self.json,)], "row string").coalesce(1)
        return df.withColumn(name, one.select(F.from_json("row", self.KIND)).scalar())

    def rank(self, t: Column, word: Column, start: Column, end: Column) -> Column:
        """Rank of the piece that word's bytes from start (from 0) up to end are; null if they are none. t: the literal."""

        def of(piece: Column) -> Column:
            h = F.xxhash64(piece)
            move = F.get(t["moves"], F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(self.buckets - 1)).cast("int"))
            at = F.shiftrightunsigned(h, self.shift).bitwiseAND(F.lit(self.slots - 1)).cast("int").bitwiseXOR(move)
            return bind(at, lambda slot: F.when(F.get(t["names"], slot) == piece, F.get(t["ranks"], slot)))

        return bind(F.substr(word, start + 1, end - start), of)

    def rank_of_two(self, t: Column, word: Column, start: Column) -> Column:
        """Rank of two bytes from start (from 0) on."""
        return F.get(t["twos"], F.shiftright(F.crc32(F.substr(word, start + 1, F.lit(2))), self.window).bitwiseAND(F.lit(65535)).cast("int"))


def _bounds(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Bounds of a short word's pieces by one pass over its candidates."""
    n = len(word)
    found = [(ranks[word[i:j]], i, j) for i in range(n) for j in range(i + 2, n + 1) if word[i:j] in ranks]
    marks = [True] * (n + 1)
    for _, i, j in sorted(found):
        if marks[i] and marks[j] and sum(marks[i + 1 : j]) == 1:
            marks[i + 1 : j] = [False] * (j - i - 1)
    return [k for k, on in enumerate(marks) if on]


def check_order(ranks: dict[bytes, int]) -> None:
    """Raise unless every byte is a piece, and one pass over a piece's candidates leaves no pair that is a piece.

    Then a merge never makes a pair of lesser rank possible: the bytes of such a pair would be one piece already.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    for piece in ranks:
        bounds = _bounds(piece, ranks)
        if any(piece[i:j] in ranks for i, j in zip(bounds, bounds[2:])):
            raise ValueError(f"the rank of {piece!r} doesn't follow its merges")


def fold_pairs(word: Column, ranks: RankMap, t: Column) -> Column:
    """Ids of a short word of at least one byte: merges of the leftmost pair of the least rank."""
    size = F.octet_length(word)
    low = PLACE_BITS + ID_BITS
    none, ids = F.lit(NO_RANK << low), F.lit((1 << ID_BITS) - 1)

    def place(s: Column, k: Column) -> Column:
        """Where piece k (from 0) starts; the word's end after the last piece."""
        return F.coalesce(at_of(F.get(s, k)).cast("int"), size)

    def at_of(piece: Column) -> Column:
        return F.shiftright(piece, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def number(rank: Column, piece: Column) -> Column:
        """A piece's number with another rank."""
        return F.coalesce(F.shiftleft(rank, low), none) + piece.bitwiseAND(F.lit((1 << low) - 1))

    def step(s: Column, _: Column) -> Column:
        def at_least(least: Column) -> Column:
            def merge(k: Column) -> Column:
                # The pair is the pieces k - 1 and k, counted from 0.
                own, start, end = F.shiftright(least, low), at_of(least), place(s, k + 1)
                right = F.when(end < size, ranks.rank(t, word, start.cast("int"), place(s, k + 2)))
                merged = F.coalesce(F.shiftleft(right, low), none) + F.shiftleft(start, ID_BITS) + own
                after = F.slice(s, k + 2, size)
                before = number(ranks.rank(t, word, place(s, k - 2), end), F.get(s, k - 2))
                return F.when(k > 1, F.concat(F.slice(s, F.lit(1), k - 2), F.array(before, merged), after)).otherwise(F.concat(F.array(merged), after))

            return F.when(least < none, having(s, F.array_position(s, least).cast("int"), merge)).otherwise(s)

        return having(s, F.array_min(s), at_least)

    def having(s: Column, value: Column, then) -> Column:
        """then(value), a state, with value computed once; ``bind`` would copy the state."""
        return F.aggregate(F.array(value), s, lambda _, x: then(x))

    def final(s: Column) -> Column:
        def of(piece: Column, k: Column) -> Column:
            own = piece.bitwiseAND(ids)
            return F.when(own == NO_RANK, ranks.rank(t, word, place(s, k), place(s, k + 1))).otherwise(own).cast("int")

        return F.transform(s, of)

    turns = F.sequence(F.lit(0), size - 1)
    start = F.transform(
        turns, lambda i: F.coalesce(F.shiftleft(F.when(i + 1 < size, ranks.rank_of_two(t, word, i)), low), none) + F.shiftleft(i.cast("long"), ID_BITS) + NO_RANK
    )
    return bind(F.aggregate(turns, start, step), final)


def fold_candidates(word: Column, ranks: RankMap, t: Column) -> Column:
    """Ids of a word of at least one byte: one pass over its candidates in the order of rank, then place."""
    size = F.octet_length(word)
    zeros, one = F.lit("0" * (1 << LENGTH_BITS)).cast("binary"), F.lit("1").cast("binary")

    def candidates_at(i: Column) -> Column:
        start = F.crc32(F.substr(word, i + 1, F.lit(3))).bitwiseAND(F.lit(STARTS - 1)).cast("int")

        def candidate(n: Column) -> Column:
            number = F.shiftleft(ranks.rank(t, word, i, i + n), LENGTH_BITS + START_BITS)
            return F.when(i + n <= size, number + F.shiftleft(i.cast("long"), LENGTH_BITS) + n)

        return F.array_compact(F.transform(F.get(t["sets"], F.get(t["starts"], start)), candidate))

    def step(marks: Column, c: Column) -> Column:
        n = c.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")
        i = F.shiftright(c, LENGTH_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")
        two = F.substr(marks, i + 1, n + 1).cast("string").rlike("^10*10*1$")
        joined = F.concat(F.substr(marks, F.lit(1), i + 1), F.substr(zeros, F.lit(1), n - 1), F.substr(marks, i + n + 1, size))
        return F.when(two, joined).otherwise(marks)

    def ids(marks: Column) -> Column:
        on = F.filter(F.sequence(F.lit(0), size), lambda k: F.substr(marks, k + 1, F.lit(1)) == one)
        return bind(on, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, k: ranks.rank(t, word, a, F.get(at, k + 1)).cast("int")))

    found = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), size - 1), candidates_at)))
    return bind(F.aggregate(found, F.repeat(F.lit("1"), size + 1).cast("binary"), step), ids)


def fold_merges(word: Column, ranks: RankMap, t: Column) -> Column:
    """Ids, as array<int>, of a word given as binary; none of an empty one. t: the map's literal, bound once."""
    size = F.octet_length(word)
    ids = F.when(size == 0, F.array().cast("array<int>"))
    for piece, rank in ranks.apart:
        ids = ids.when(word == F.lit(piece), F.array(F.lit(rank)))
    return ids.when(size <= SHORT, fold_pairs(word, ranks, t)).otherwise(fold_candidates(word, ranks, t))


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n for the distinct pattern words of all texts."""
    return docs.select(F.explode(words_of(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than rows) and values of a column of id lists."""
    starts = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    return starts - starts[0], values.astype("<u4")


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int, finish: Callable, schema: str, apart: bool = False) -> DataFrame:
    """finish(doc_ids, ids, bounds) of every batch of rows; the ids of its row k are ids[bounds[k] : bounds[k + 1]].

    apart: the codes are written between the two Python steps, so that a task runs one worker and not two.
    """
    spark = prepare(docs.sparkSession)
    rank_map = RankMap(ranks)
    top, _ = most_frequent(settle(word_counts(docs, pattern), "words"), frequent)
    spread = top.select("word").repartition(2 * spark.sparkContext.defaultParallelism)
    coded = rank_map.beside(spread, "map").select("word", bind(F.col("map"), lambda t: fold_merges(F.col("word").cast("binary"), rank_map, t)).alias("ids"))
    # A task's words stand in one blob, in the order of the blobs' codes.
    shared = spark.sparkContext.broadcast(collect_blobs(coded))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_blobs(shared.value)
        index = WordIndex(known["word"].combine_chunks() if known else pa.array([], pa.string()))
        del known
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten().dictionary_encode()
            spot = index.places(flat.dictionary)
            new = spot < 0
            rare = flat.dictionary.filter(pa.array(new))
            spot[new] = len(index.names) + np.arange(len(rare))
            codes = spot[flat.indices.to_numpy(zero_copy_only=False)].astype("<u4")
            rows = [batch.column(0).to_pylist()], [words.value_lengths().to_pylist()], [codes.tobytes()], [rare.to_pylist()]
            kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["doc_ids", "sizes", "codes", "rare"])
            del words, flat, rare, codes, rows
            pa.default_memory_pool().release_unused()

    looked = docs.select("doc_id", words_of(F.col("text"), pattern).alias("words")).mapInArrow(
        look_up, "doc_ids array<long>, sizes array<int>, codes binary, rare array<string>"
    )
    rare = bind(F.col("map"), lambda t: F.transform("rare", lambda w: fold_merges(w.cast("binary"), rank_map, t)))
    folded = rank_map.beside(looked, "map").select("doc_ids", "sizes", "codes", rare.alias("rare"))
    if apart:
        folded = settle(folded, "codes")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_blobs(shared.value)
        known_starts, known_ids = _lists(known["ids"].combine_chunks()) if known else (np.zeros(1, np.int64), np.zeros(0, "<u4"))
        del known
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                doc_ids, words = row.column(0).flatten(), row.column(1).flatten().to_numpy(zero_copy_only=False)
                place = np.frombuffer(row.column(2)[0].as_py(), "<u4").astype(np.int64)
                rare_starts, rare_ids = _lists(row.column(3).flatten())
                starts = np.concatenate([known_starts[:-1], rare_starts[:-1] + len(known_ids)])
                sizes = np.concatenate([np.diff(known_starts), np.diff(rare_starts)])[place]
                ends = np.cumsum(sizes)
                spots = np.repeat(starts[place] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
                ids = np.concatenate([known_ids, rare_ids])[spots]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
                yield finish(doc_ids, ids, bounds)

    return folded.mapInArrow(join_up, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row's whole text."""

    def finish(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        own = [ids[i:j].tobytes() for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(own, pa.binary())], ["doc_id", "ids"])

    return _encoded(docs, ranks, pattern, frequent, finish, "doc_id long, ids binary")


def decoder(ranks: dict[bytes, int]) -> Callable[[np.ndarray], tuple[np.ndarray, bytes]]:
    """Function from ids to the bounds of each id's bytes and the bytes: the ids' pieces one after another."""
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = pa.array(pieces, pa.binary())

    def run(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        found = table.take(pa.array(ids.astype(np.int64)))
        return np.frombuffer(found.buffers()[1], np.int32, len(ids) + 1), found.buffers()[2].to_pybytes() if len(ids) else b""

    return run


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and text (binary) from the ids that ``encode`` gives; null ids are no text."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = decoder(shared.value)
        for batch in batches:
            texts = [to_bytes(np.frombuffer(x, "<u4"))[1] if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT, apart: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the SHA-256 of the decoded ids, for every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    held: list[Callable] = []

    def finish(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        if not held:
            held.append(decoder(shared.value))
        ends, text = held[0](ids)
        spans = list(zip(bounds.tolist(), bounds[1:].tolist()))
        columns = [
            doc_ids,
            pa.array(np.diff(bounds)),
            pa.array([sha256(ids[i:j]).hexdigest() for i, j in spans], pa.string()),
            pa.array([sha256(text[ends[i] : ends[j]]).hexdigest() for i, j in spans], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, ranks, pattern, frequent, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", apart)
