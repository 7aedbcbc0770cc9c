"""Conversation repair against all edit sequences, and against a plain run of the contract."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from wordweft.llm import dialogue, queries

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(symbols: bytes, extra: int) -> tuple[int, str]:
    """Least (cost, audit) of all edits with at most ``extra`` insertions."""
    best = None

    def walk(i: int, roles: str, cost: int, audit: str, left: int) -> None:
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(symbols) and GOOD.fullmatch(roles):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if left:
            for x in "ua":
                walk(i, roles + x, cost + 5, audit + "I", left - 1)
        if i < len(symbols):
            s = symbols[i]
            walk(i + 1, roles, cost + 2, audit + "D", left)
            if s != dialogue.GONE:
                stay = 5 if s > 3 else 0
                walk(i + 1, roles + "suax"[s & 3], cost + stay, audit + "K", left)
                for x in "ua":
                    walk(i + 1, roles + x, cost + stay + 1, audit + "R", left)

    walk(0, "", 0, "", extra)
    return best


def test_cheapest_edits_are_least_of_all():
    for n in range(4):
        for symbols in product(range(9), repeat=n):
            assert dialogue.cheapest_edits(bytes(symbols)) == all_edits(bytes(symbols), 2), symbols
    rng = random.Random(1)
    for _ in range(60):
        symbols = bytes(rng.choices(range(9), weights=[2, 6, 6, 1, 1, 1, 1, 1, 2], k=7))
        assert dialogue.cheapest_edits(symbols) == all_edits(symbols, 1), symbols


def test_insertions_where_deletions_are_dear():
    costs = dialogue.Costs(delete=50, rerole=50)
    assert dialogue.cheapest_edits(bytes([0]), costs) == (10, "KII")
    assert dialogue.cheapest_edits(bytes([1, 1, 2]), costs) == (5, "KIKK")
    assert dialogue.cheapest_edits(bytes([2]), costs) == (5, "IK")


def test_blocks_give_the_same_edits(monkeypatch):
    rng = random.Random(2)
    symbols = bytes(rng.choices(range(9), k=500))
    want = dialogue.cheapest_edits(symbols)
    for root in (0, 1, 6, 499, 1000):
        monkeypatch.setattr(dialogue, "isqrt", lambda n, r=root: r)
        assert dialogue.cheapest_edits(symbols) == want


def brute(rows):
    """The contract, conversation by conversation."""
    blanks = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            shown = text.rstrip(blanks)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            initial = "sua".find(role[:1]) if role else -1
            symbols.append(8 if fault in (0, 1) else (3 if initial < 0 else initial) + (4 if fault == 2 else 0))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit = dialogue.cheapest_edits(bytes(symbols))
        lines, state, k = [], "", 0
        for edit in audit:
            if edit == "I":
                role, text = None, ""
            else:
                _, role, text = held[k]
                k += 1
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def as_dict(df):
    rows = df.collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "no", " ", "", "Why?", "Ça va!", None, "x" * 70_000 + ".", "tail. \n", " ", "dot . \x0b"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "understudy"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6), 90]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts)) for _ in range(600)]
    return rows + rows[:30] + [(99, None, "user", "a."), (98, 1, "system", "s.")]


def test_report_follows_the_contract(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("kind", F.lit(7))
    want = brute(odd_rows)
    assert as_dict(dialogue.report(df.repartition(7))) == want
    assert as_dict(dialogue.report(df.coalesce(1))) == want


def test_empty_table(spark):
    assert dialogue.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 977}.") for t in range(4000)]
    assert as_dict(dialogue.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repaired_rows_are_well_formed(spark, odd_rows):
    rows = dialogue.damage(spark.createDataFrame(odd_rows, SCHEMA))
    turns = dialogue.repaired(rows, dialogue.audits(rows)).collect()
    for conv in {r["conv_id"] for r in turns}:
        mine = sorted((r["place"], r["role"]) for r in turns if r["conv_id"] == conv)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert GOOD.fullmatch("".join(r[0] for _, r in mine))


def test_op12_on_the_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(queries.op12_conversations(spark, path)) == brute(rows)
