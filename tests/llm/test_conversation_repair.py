"""Repaired conversations: the cheapest edits against all edits, SQL against the query, damage, odd rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb

from ledgerloom.llm import conversation_repair as repair, queries
from ledgerloom.llm.oracles import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, copies int, cost string, audit string"


def all_edits(rows, inserts):
    """(cost, initials, roles) of every way to edit rows of (initial, fault), legal or not."""
    def ways(i, left):
        if left:
            for role in "ua":
                for cost, audit, roles in ways(i, left - 1):
                    yield cost + 5, "I" + audit, role + roles
        if i == len(rows):
            yield 0, "", ""
            return
        initial, fault = rows[i]
        for cost, audit, roles in ways(i + 1, left):
            yield cost + 2, "D" + audit, roles
            if fault != 1:
                more = 5 if fault == 2 else 0
                yield cost + more, "K" + audit, initial + roles
                for role in "ua":
                    yield cost + 1 + more, "R" + audit, role + roles
    return ways(0, inserts)


def test_cheapest_against_all_edits():
    patterns = [p for n in range(4) for p in product(product("suax", (0, 1, 2)), repeat=n)]
    patterns = random.Random(3).sample(patterns, 700) + random.Random(4).sample(list(product(product("suax", (0, 2)), repeat=4)), 60)
    for rows in patterns:
        want = min((c, a) for c, a, r in all_edits(rows, 2) if re.fullmatch("(s?(ua)+)?", r))
        assert repair.cheapest(bytes("suax".index(x) + 4 * f for x, f in rows)) == want, rows


def test_edits_give_legal_rows_of_that_cost():
    rng = random.Random(9)
    for n in (1, 7, 60, 700):
        turns = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", " ", "c!", f"text {rng.random()}."])) for _ in range(n)]
        found, _, cost, audit, kept = repair.repair(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        at, total = 0, 0
        for edit in audit:
            total += {"D": 2, "I": 5, "K": 0, "R": 1}[edit]
            if edit != "I":
                assert edit == "D" or found[at] not in ("blank", "duplicate")
                total += 5 * (edit != "D" and found[at] == "truncated")
                at += 1
        assert at == n and total == cost <= 2 * n


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    names = [c[0] for c in con.execute(f"DESCRIBE {ORACLES['op13_conversation_repair']}").fetchall()]
    found = queries.op13_conversation_repair(spark, folder)
    assert sorted(names) == sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op13_conversation_repair']})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert len(got) > 50 and sorted(got) == sorted(want)


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in range(30) for t in range(8)] + [(None, 3, None, None), (5, None, "user", "x")]
    table = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in repair.damaged(table).collect()), key=str)
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {0: "", 1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want.append((conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=str) and {w[4] for w in want} == {0, 1, 2}


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi.", 1), (1, 5, "user", "hi.", 1), (1, None, "system", "be kind.", 1), (1, 2, "assistant", "well\n\t", 1),
            (2, 0, "user", "gone", 0), (3, 0, "", "", 1), (3, 0, " ", " \n", 2), (None, 4, "user", "q?", 1), (None, 4, "assistant", "a!", 1),
            *[(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i}. " + "long " * (20_000 if i == 7 else 1) + ".", 1) for i in range(900)]]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = {r.conv_id: r for r in repair.repair_conversations(table).collect()}
    one = found[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 0, 1, 1, 0, 6, "RRDD")
    assert [tuple(r) for r in one.repaired] == [("user", "be kind."), ("assistant", "hi.")]  # cheaper than to keep the truncated row
    assert tuple(found[2])[1:] == (0, 0, 0, 0, 0, 0, "", [])
    assert (found[3].blank, found[3].illegal, found[3].cost, found[3].audit) == (3, 2, 6, "DDD")
    # Turns that share a number are ordered by role.
    assert found[None].gaps == 0 and [r.role for r in found[None].repaired] == ["user", "assistant"]
    assert found[4].audit == "K" * 900 and len(found[4].repaired) == 900
    none = repair.repair_digest(table.where("conv_id = 77"))
    assert none.count() == 0
    digest = {r.conv_id: r.repaired_sha256 for r in repair.repair_digest(table.drop("copies", "cost", "audit")).collect()}
    assert set(digest) == {1, 2, 3, 4, None} and digest[3] == hashlib.sha256(b"").hexdigest()
