"""Conversation structure repair: the cheapest edits that make turns alternate, found by one integer minimum.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Rows are kept (cost 0), get
the role that is due (Rerole, 1), go (Delete, 2; the only choice for blank and duplicate rows) or an
empty row of the role that is due is put in (Insert, 5); a truncated row that does not go costs 5 more.
Among the cheapest sequences of edits the one whose initials (``D I K R``) come first in ASCII order
is taken, so the result is unique.

Weights are single integers. The high part counts the cost; below it stand ``width`` octal digits, the
initials of the edits in order, coded 1 to 4 and filled up with zeros at the end. Since a shorter
sequence that begins a longer one is smaller with its zeros, comparing two integers compares cost
first and initials then. The nodes of the graph are (rows left, what was written last: nothing, s, u
or a); a node's weight is the smallest of its edges' weights plus the edge: cost added on top, the
following initials moved one digit down and the edge's own put in front. Nothing is traced back: the
smallest integer at the start holds the cost and all edits. Inserts stay within a layer, and two in
a row from u or a only return to where they began, so each layer is closed in one step.

A conversation has at most two inserts for five rows in a cheapest sequence, as deleting all rows
costs two each; that bounds ``width``.

Rows are shuffled by conversation and sorted inside partitions; a task holds one conversation at a
time, a training sample, and four integers for it. Conversations with the same pattern of initials
and faults share one solution.

Nulls and odd rows: a null role, text, conv_id or turn counts as one space in the damage's key, and a
null role or text is one space from there on; rows without a conv_id are the conversation null; null
turns come first, turns that share a number are ordered by role and text (after the damage); a
conversation that has lost all rows has zeros, no edits and no rows; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LETTERS = "DIKR"  # codes 1 to 4, in ASCII order
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
SOUND, REMOVED, TRUNCATED = 0, 1, 2  # what a row's fault means for the edits
LEGAL_PAIRS = {"su", "ua", "au"}
REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired array<struct<role: string, text: string>>")
# Characters of text after which a batch of repaired conversations is handed on.
BATCH_CHARS = 1 << 20


# ---------------------------------------------------------------- damage

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with damage that depends on conversation and turn only.

    ``copies`` is how often the row stands in the conversation: 0 if it was dropped, 2 if repeated.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


# ---------------------------------------------------------------- edits

@lru_cache(maxsize=200_000)
def cheapest(pattern: bytes) -> tuple[int, str]:
    """(cost, initials of the edits) for rows given as initial (0 s, 1 u, 2 a, 3 other) + 4 x fault."""
    width = len(pattern) + 2 * len(pattern) // 5 + 4
    bits, top = 3 * width, 3 * (width - 1)
    digits = (1 << bits) - 1
    never = 1 << (bits + 48)

    def edge(weight: int, letter: int, more: int = 0) -> int:
        """The weight of an edge into a node of this weight."""
        return ((weight >> bits) + COST[letter] + more << bits) | letter << top | (weight & digits) >> 3

    def closed(nothing: int, s: int, u: int, a: int) -> tuple[int, int, int, int]:
        """The nodes of one layer with the rows that may be put in before the next one."""
        after_u, after_a = min(u, edge(a, INSERT)), min(a, edge(u, INSERT))
        with_user = edge(after_u, INSERT)
        return min(nothing, with_user), min(s, with_user), after_u, after_a

    nothing, s, u, a = closed(0, never, never, 0)
    for code in reversed(pattern):
        initial, fault = code & 3, code >> 2
        bases = [edge(w, DELETE) for w in (nothing, s, u, a)]
        if fault != REMOVED:
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            user = edge(u, KEEP, more) if initial == 1 else edge(u, REROLE, more)
            answer = edge(a, KEEP, more) if initial == 2 else edge(a, REROLE, more)
            bases = [min(bases[0], user), min(bases[1], user), min(bases[2], answer), min(bases[3], user)]
            if initial == 0:
                bases[0] = min(bases[0], edge(s, KEEP, more))
        nothing, s, u, a = closed(*bases)
    letters = format(nothing & digits, "o").zfill(width).rstrip("0")
    return nothing >> bits, letters.translate({ord(str(k + 1)): x for k, x in enumerate(LETTERS)})


def applied(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, rows, last = [], iter(turns), ""
    for edit in audit:
        due = "assistant" if last == "u" else "user"
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        out.append((role if edit == "K" else due, text))
        last = out[-1][0][:1]
    return out


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or none."""
    seen, out = set(), []
    for role, text in turns:
        visible = text.rstrip(BLANKS)
        if not visible:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if visible[-1] in STOPS else "truncated")
        seen.add((role, text))
    return out


def repair(turns: list[tuple[str, str]]) -> tuple[list[str], int, int, str, list[tuple[str, str]]]:
    """(faults, illegal pairs, cost, initials of the edits, repaired rows)."""
    found = faults(turns)
    weight = {"": SOUND, "truncated": TRUNCATED}
    initials = [role[:1] for role, _ in turns]
    pattern = bytes({"s": 0, "u": 1, "a": 2}.get(x, 3) + 4 * weight.get(f, REMOVED) for x, f in zip(initials, found))
    illegal = sum(x + y not in LEGAL_PAIRS for x, y in zip(initials, initials[1:]))
    cost, audit = cheapest(pattern)
    return found, illegal, cost, audit, applied(turns, audit)


# ---------------------------------------------------------------- tables

def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): faults, edits and repaired rows."""
    def conversations(batches):
        current, held = None, None
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if held is None or conv != current:
                    if held is not None:
                        yield current, held
                    current, held = conv, []
                turn, role, text, copies = row
                held.extend([(turn, role, text)] * copies)
        if held is not None:
            yield current, held

    def as_batch(done):
        columns = list(zip(*done))
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def write(batches):
        done, chars = [], 0
        for conv, held in conversations(batches):
            numbers = [t for t, _, _ in held if t is not None]
            gaps = numbers[-1] - numbers[0] + 1 - len(set(numbers)) if numbers else 0
            found, illegal, cost, audit, kept = repair([(r, t) for _, r, t in held])
            done.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                         [{"role": r, "text": t} for r, t in kept]))
            chars += sum(len(t) for _, t in kept) + 200
            if chars >= BATCH_CHARS:
                yield as_batch(done)
                done, chars = [], 0
        if done:
            yield as_batch(done)

    ordered = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(write, REPAIRED)


def repair_digest(rows: DataFrame) -> DataFrame:
    """The repaired conversations of damaged ``rows`` with a digest in place of their rows."""
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    found = repair_conversations(damaged(rows))
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")
