"""Line deduplication by pairwise alignment.

Lines are hashed after trimming white space. Documents are linked by the hashes of their shortest
line runs that reach ``block_words`` words, from each line onwards and from each line back: two
documents have a common block of so many words only if they share such a run, and the runs of a
block cover all its lines. A run in at most ``rare`` documents links each of them to every earlier
one, a more frequent run links each to the first holder, which has the whole run, and to a holder
before it, so the number of pairs grows with the number of lines and no run is passed over. Each
pair is aligned by patience diff on line hashes: lines that are unique in both and in the same
order are anchors, gaps between anchors are aligned the same way, and matches grow from both ends
of a gap. A gap without such lines is aligned at its longest common run (in words). Aligned common
blocks of at least ``block_words`` words are deleted from the later document (the larger doc_id),
wherever it repeats them. A document's result is the union over its pairs; the first document to
hold a block keeps it.

Only line hashes and word counts travel with the pairs, not texts.

Nulls and odd rows: null and empty texts have no lines to delete; blank lines are no anchors and go
with the block around them only; lines repeated inside one document are left there unless an
earlier document has them in an aligned block; documents that share a doc_id are one document
whose texts are joined in order of their hash; rows without doc_id are kept as they are; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.scratch import materialise

RARE = 8
MULTIPLIER = 0x9E3779B97F4A7C15
BLOCK_WORDS = 10


def patience_matches(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Index pairs of equal items of two sequences, increasing in both.

    Common ends are matched first; inside, items unique on both sides are anchors (a longest
    increasing subsequence of them), and the gaps between anchors are treated alike, on an explicit
    stack so that long documents need no deep recursion. A range without anchors is matched at its
    heaviest common run, if that has ``least`` of ``words`` (of the second sequence; one each if not
    given), and beside it: lighter runs in it are in no block, as common ends are matched before.
    """
    weights = [0, *accumulate(words or [1] * len(b))]
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if not anchors:
            x, y, n = _heaviest_run(a, b, weights, a0, a1, b0, b1)
            if n == 0 or weights[y + n] - weights[y] < least:
                continue
            anchors = [(x + k, y + k) for k in range(n)]
        left_a, left_b = a0, b0
        for x, y in anchors:
            out.append((x, y))
            stack.append((left_a, x, left_b, y))
            left_a, left_b = x + 1, y + 1
        stack.append((left_a, a1, left_b, b1))
    return sorted(out)


def _anchors(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """The longest increasing run of items that occur once in each range."""
    def once(items, low, high):
        at: dict[int, int] = {}
        for i in range(low, high):
            at[items[i]] = -1 if items[i] in at else i
        return at

    in_a, in_b = once(a, a0, a1), once(b, b0, b1)
    pairs = sorted((i, in_b[x]) for x, i in in_a.items() if i >= 0 and in_b.get(x, -1) >= 0)
    tails, tops, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tails, j)
        back.append(tops[pile - 1] if pile else -1)
        if pile == len(tails):
            tails.append(j)
            tops.append(k)
        else:
            tails[pile], tops[pile] = j, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _heaviest_run(a, b, weights, a0, a1, b0, b1) -> tuple[int, int, int]:
    """Where the common run of both ranges with most weight begins in each, and its length (0 if there is none)."""
    if set(a[a0:a1]).isdisjoint(x for x in b[b0:b1] if x != 0):
        return a0, b0, 0
    steps, link, length, last, at = [{}], [-1], [0], [a0], 0  # the suffix automaton of the first range
    for i in range(a0, a1):
        new, p = len(steps), at
        steps.append({})
        link.append(0)
        length.append(length[at] + 1)
        last.append(i)
        while p >= 0 and a[i] not in steps[p]:
            steps[p][a[i]] = new
            p = link[p]
        if p >= 0:
            q = steps[p][a[i]]
            if length[q] != length[p] + 1:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                last.append(last[q])
                while p >= 0 and steps[p].get(a[i]) == q:
                    steps[p][a[i]] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        at = new
    best, state, n = (0, a0, b0, 0), 0, 0
    for j in range(b0, b1):
        while state and b[j] not in steps[state]:
            state = link[state]
            n = length[state]
        if b[j] in steps[state]:
            state, n = steps[state][b[j]], n + 1
            weight = weights[j + 1] - weights[j + 1 - n]
            if weight > best[0]:
                best = (weight, last[state] - n + 1, j + 1 - n, n)
    return best[1:]


def repeated(items: list[int], gone: list[int]) -> list[int]:
    """The indexes of a sequence in any stretch that equals one of the runs of consecutive indexes in ``gone``."""
    often: dict[int, int] = {}
    for x in items:
        often[x] = often.get(x, 0) + 1
    out, runs = set(gone), {}
    for k, i in enumerate(gone):
        if k == 0 or gone[k - 1] != i - 1:
            low = i
        if k + 1 == len(gone) or gone[k + 1] != i + 1:
            runs[tuple(items[low:i + 1])] = None
    for run in runs:
        if min(often[x] for x in run) == 1:
            continue  # stands here only
        border, k = [0] * len(run), 0
        for i in range(1, len(run)):
            while k and run[i] != run[k]:
                k = border[k - 1]
            k += run[i] == run[k]
            border[i] = k
        k = covered = 0
        for i, x in enumerate(items):
            while k and x != run[k]:
                k = border[k - 1]
            k += x == run[k]
            if k == len(run):
                out.update(range(max(covered, i + 1 - k), i + 1))
                covered, k = i + 1, border[k - 1]
    return sorted(out)


def blocks(matches: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """The second indexes of matches in blocks (runs in both sequences) of at least so many words."""
    out, run = [], []
    for match in [*matches, None]:
        if match is None or (run and match != (run[-1][0] + 1, run[-1][1] + 1)):
            if sum(words[y] for _, y in run) >= least:
                out += [y for _, y in run]
            run = []
        if match is not None:
            run.append(match)
    return out


def marked(first: list[int], second: list[int], words: list[int], least: int) -> list[int]:
    """The lines of the second document that go: aligned blocks, and what repeats one of them.

    What is left is aligned again until no block is found: blocks that stand in another order
    cross, so that one alignment cannot have them all.
    """
    gone, rest, known = set(), list(second), set(first)
    while sum(words[j] for j, x in enumerate(rest) if x in known) >= least:
        found, run = set(), []
        for match in [*patience_matches(first, rest, words, least), None]:
            if match is None or (run and match != (run[-1][0] + 1, run[-1][1] + 1)):
                block = blocks(run, words, least)
                found.update(repeated(second, block) if block else [])
                run = []
            if match is not None:
                run.append(match)
        if not found - gone:
            break
        gone |= found
        for j in found:
            rest[j] = None  # equals no line
    return sorted(gone)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, words): per document its lines' hashes (0 for blank ones) and word counts."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_t"), trimmed.alias("_lines"))
    rows = rows.select("doc_id", "_t", F.transform("_lines", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("hashes"),
                       F.transform("_lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("words"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_t", "hashes", "words"))).alias("_all")).select(
        "doc_id", F.flatten("_all.hashes").alias("hashes"), F.flatten("_all.words").alias("words"))


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """The distinct hashes of the shortest runs of at least so many words from each line onwards and from each line back.

    Runs begin and end with lines that have words; a run of one line has the line's own hash.
    """
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words)])
    with np.errstate(over="ignore"):
        power, inverse = (np.cumprod(np.array([1] + [x] * n, np.uint64)) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * power[:n])])
        at = np.flatnonzero(words > 0)
        end = np.searchsorted(before, before[at] + least)  # the first end that reaches the words
        low, high = at[end <= n], end[end <= n]
        start = np.searchsorted(before, before[at + 1] - least, "right") - 1  # the last start that does
        low, high = np.concatenate([low, start[start >= 0]]), np.concatenate([high, at[start >= 0] + 1])
        return np.unique((total[high] - total[low]) * inverse[low]).view(np.int64)


def candidate_pairs(lines: DataFrame, rare: int = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(earlier, later): documents that share a line run, as the module says; at most ``rare`` - 1 or two per run and document.

    The holder before is found in the order of doc_id among holders that agree on a hash of their
    id, in slices of about ``rare`` documents, so that a run in a third of all documents is not
    sorted in one task.
    """
    def runs(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [run_hashes(np.array(h.as_py(), np.int64), np.array(w.as_py(), np.int64), block_words) for h, w in zip(part.column("hashes"), part.column("words"))]
                ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(ids, pa.int64())], names=["hash", "doc_id"])

    held = lines.select("doc_id", "hashes", "words").mapInArrow(runs, "hash long, doc_id long")
    per_line = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("n > 1")
    per_line = materialise(per_line, "line-holders")
    two = per_line.where("n = 2").select(F.col("first").alias("earlier"), F.col("last").alias("later"))
    more = materialise(held.join(per_line.where("n > 2").drop("last"), "hash"), "line-links")
    star = more.where("doc_id > first").select(F.col("first").alias("earlier"), F.col("doc_id").alias("later"))
    few = more.where(F.col("n") <= rare)
    pairs = few.join(few.select("hash", F.col("doc_id").alias("earlier")), "hash").where("earlier < doc_id").select("earlier", F.col("doc_id").alias("later"))
    slices = F.ceil(F.col("n") / rare)
    piece = F.pmod(F.xxhash64("doc_id"), slices)
    before = F.lag("doc_id").over(W.partitionBy("hash", "_slice").orderBy("doc_id"))
    chain = (more.where(F.col("n") > rare).withColumn("_slice", piece).withColumn("earlier", before)
             .where("earlier is not null").select("earlier", F.col("doc_id").alias("later")))
    return two.union(star).union(pairs).union(chain).distinct()


def deletions(docs: DataFrame, rare: int = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, deleted): the sorted line numbers (from 0) that go, of documents that lose any."""
    lines = materialise(hashed_lines(docs), "line-hashes")
    pairs = materialise(candidate_pairs(lines, rare, block_words), "line-pairs")

    def align(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("first_hashes", "hashes", "words")]
            for i in range(batch.num_rows):
                first, second, words = (c[i].as_py() for c in columns)
                out.append(marked(first, second, words, block_words))
            yield pa.RecordBatch.from_arrays([batch.column("later"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "gone"])

    first = lines.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("first_hashes"))
    second = lines.select(F.col("doc_id").alias("later"), "hashes", "words")
    aligned = (pairs.join(first, "earlier").join(second, "later").select("later", "first_hashes", "hashes", "words")
               .mapInArrow(align, "doc_id long, gone array<int>"))
    gone = aligned.select("doc_id", F.explode("gone").alias("line")).distinct()
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("deleted"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_text of every document (rows with one id joined by line feeds; without an id, row by row)."""
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_t"))
    whole = whole.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_t", "text"))).alias("_all"))
    rows = whole.join(deletions(docs, **options), "doc_id", "left").withColumn("_lines", F.split(F.concat_ws("\n", "_all.text"), "\n"))
    gone = F.coalesce("deleted", F.array().cast("array<int>"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.transform(stays, lambda i: F.element_at("_lines", i + 1))
    text = F.coalesce("text", F.lit(""))
    unnamed = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"), text.alias("kept_text"))
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"),
                       F.array_join(kept, "\n").alias("kept_text")).unionByName(unnamed)
