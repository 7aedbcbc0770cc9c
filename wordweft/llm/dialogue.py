"""Conversation structure repair: cheapest edits that give roles of the form (s? (ua)+)?, by a checkpointed DP.

A conversation's rows go by turn (nulls first; rows of one turn by role, then by digest of the text). ``audits`` finds each
row's first fault in Spark and hands a task one small row for each distinct (turn, role, text) of a conversation, sorted, so
that a conversation is held there as one byte a row, no more than its audit, which has a letter a row. The DP goes backward
over four role states, keeps its cost vectors only at every sqrt(n)-th row, and recomputes one block at a time while it walks
forward and emits, among the edits that are still tight, the one whose initial is least in ASCII: D, I, K, R.
``repaired`` sends texts past their conversation's audit, sorted, and never holds a conversation's texts.

Defined cases: a null role or text is one blank, so is a null conv_id or turn in the damage's key; conversations with a null
conv_id are one; a conversation without rows after damage has zeros and an empty audit; roles count by their first
character, case included, and an empty role has none; an empty table gives no rows; repeated rows are rows; texts may have
any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle

BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
#: Role states: nothing yet, after s, after u, after a; where a row kept as s, u or a leads, and where a new or changed role does.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
TURN = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: initial (s, u, a, other) for a sound row, the same plus 4 for a truncated one, 8 for one that has to go.
GONE = 8


@dataclass(frozen=True)
class Costs:
    """What edits cost; truncated is added where a truncated row stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _insertions(v: list[float], cost: int) -> list[float]:
    """Costs from each state when rows may be inserted first."""
    user, assistant = min(v[USER], cost + v[ASSISTANT]), min(v[ASSISTANT], cost + v[USER])
    return [min(v[START], cost + user), min(v[SYSTEM], cost + user), user, assistant]


def _before(symbol: int, after: list[float], costs: Costs) -> list[float]:
    """Costs of a row and all that follows, by the state before it; after: the costs of what follows."""
    out = [costs.delete + x for x in after]
    if symbol != GONE:
        stay = costs.truncated if symbol > 3 else 0
        for state in range(4):
            kept = KEEP[state][symbol & 3]
            out[state] = min(out[state], stay + after[kept] if kept >= 0 else inf, stay + costs.rerole + after[TURN[state]])
    return _insertions(out, costs.insert)


def cheapest_edits(symbols: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, ASCII-least among equals; holds O(sqrt(n)) cost vectors."""
    n = len(symbols)
    step = isqrt(n) + 1
    v = _insertions([0, inf, inf, 0], costs.insert)
    marks = {n: v}
    for i in range(n - 1, -1, -1):
        v = _before(symbols[i], v, costs)
        if i % step == 0:
            marks[i] = v
    total, state, out = v[START], START, []
    for low in range(0, max(n, 1), step):
        high = min(low + step, n)
        block = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(_before(symbols[i], block[-1], costs))
        block.reverse()
        for i in range(low, high):
            here, after, symbol = block[i - low], block[i - low + 1], symbols[i]
            while True:
                if costs.delete + after[state] == here[state]:
                    out.append("D")
                    break
                if costs.insert + here[TURN[state]] == here[state]:
                    out.append("I")
                    state = TURN[state]
                    continue
                stay = costs.truncated if symbol > 3 else 0
                kept = KEEP[state][symbol & 3]
                if kept >= 0 and stay + after[kept] == here[state]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = TURN[state]
                break
        marks.pop(low, None)
    # What is still wanted after the last row can only be inserted.
    while state in (SYSTEM, USER):
        out.append("I")
        state = TURN[state]
    return int(total), "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("digest")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, initial (place in ``INITIALS``, else 3), blank, truncated, repeated.

    A row for each distinct (turn, role, text) of a conversation, rows without copies too; repeated: role and text were seen
    in an earlier turn. Equal rows are counted before anything is sorted.
    """
    shown = F.expr(f"trim(TRAILING '{BLANKS}' FROM text)")
    marked = rows.select("conv_id", "turn", "role", _digest(), "copies", (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    held = marked.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.asc_nulls_first("turn")))
    return held.select("conv_id", "turn", "role", "digest", "copies", F.when((initial < 0) | (F.col("role") == ""), 3).otherwise(initial).alias("initial"), "blank", "truncated", (first > 1).alias("repeated"))


AUDIT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


class _Conversation:
    """Symbols and counts of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.turns, self.last_turn, self.first_turn = conv_id, bytearray(), 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = -1

    def add(self, turn, copies, initial, blank, truncated, repeated) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        # s before u, u before a and a before u may stand side by side; a row and its copy never may.
        if self.last >= 0:
            self.illegal += (self.last, initial) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += copies - 1
        self.last = initial
        if blank:
            self.blank += copies
            self.symbols.extend([GONE] * copies)
            return
        again = copies if repeated else copies - 1
        self.duplicate += again
        if not repeated:
            self.truncated += truncated
            self.symbols.append(initial + 4 * truncated)
        self.symbols.extend([GONE] * again)

    def row(self, costs: Costs) -> tuple:
        cost, audit = cheapest_edits(bytes(self.symbols), costs)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _packed(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) == most or size > 1 << 22:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def audits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of rows (with copies)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, part in groupby(_rows(batches), lambda r: r[0]):
                found = _Conversation(conv_id)
                for row in part:
                    found.add(*row[1:])
                yield found.row(costs)

        yield from _packed(each(), AUDIT)

    sorted_ = faults(rows).repartition("conv_id").sortWithinPartitions(*_order())
    return sorted_.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "copies", "initial", "blank", "truncated", "repeated").mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _order(*first: str) -> list[Column]:
    return [F.asc_nulls_first("conv_id"), *[F.col(c) for c in first], F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, role, text) of each row that stays or comes, from a conversation's audit and its (role, text) rows in order."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = KEEP[state][INITIALS.index(role[0])] if edit == "K" else TURN[state]
        yield edit, role if edit == "K" else NAME[state], text


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of the repaired conversations, each one's rows together and in order."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, part in groupby(_rows(batches), lambda r: r[0]):
                audit = next(part)[1]
                texts = ((role, text) for _, _, role, text, copies in part for _ in range(copies))
                for place, (edit, role, text) in enumerate(edited(audit, texts)):
                    yield conv_id, place, edit, role, text

        yield from _packed(each(), TURNS)

    told = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit", *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")], F.lit(0).alias("copies"))
    texts = rows.where("copies > 0").select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long"), F.lit(None).cast("string").alias("audit"), "role", _digest(), "text", "copies")
    both = told.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order("kind"))
    return both.select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines, from ``repaired`` itself, whose order is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, part in groupby(_rows(batches), lambda r: r[0]):
                found = hashlib.sha256()
                for _, place, _, role, text in part:
                    found.update((("\n" if place else "") + f"{role}:{text}").encode())
                yield conv_id, found.hexdigest()

        yield from _packed(each(), DIGEST)

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Counts, audit and digest of the repaired form of every damaged conversation."""
    rows = damage(conversations)
    audited = settle(audits(rows, costs), "audits")
    found = digests(repaired(rows, audited)).withColumnRenamed("conv_id", "id")
    empty = hashlib.sha256(b"").hexdigest()
    return audited.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(*AUDIT.names, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
