"""Decontamination: planted passages with substitutions, chance overlaps, odd rows."""

import random

from ledgerloom.llm import decontaminate as leak


def benchmark_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "item_id long, text string, words string, seed double")


def test_planted_passages(spark, documents):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(30)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = {i: text(rng.randint(15, 60)) for i in range(40)}
    rows, want = [], set()
    for d in range(300):
        body = text(rng.randint(0, 400))
        if d % 3 == 0:
            item = d // 3 % 40
            passage = list(items[item])
            for at in rng.sample(range(len(passage)), len(passage) // 15):  # one word in fifteen
                passage[at] = word()
            at = rng.randint(0, len(body))
            style = [" ".join, lambda w: ", ".join(x.upper() for x in w), lambda w: "\n".join(w)][d % 3]
            body[at:at] = [style(passage)]
            want.add((d, item))
        rows.append((d, " ".join(body)))
    bench = benchmark_table(spark, [(i, " ".join(w)) for i, w in items.items()])
    table = documents(rows)
    assert {(r.doc_id, r.item_id) for r in leak.contaminated(table, bench).collect()} == want
    clean = leak.clean_documents(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == set(range(300)) - {d for d, _ in want}


def test_places_and_score(spark, documents):
    passage = [f"p{i}" for i in range(20)]
    broken = passage[:7] + ["other"] + passage[8:]
    bench = benchmark_table(spark, [(1, " ".join(passage)), (2, " ".join(passage)), (3, "short one"), (None, "short one"), (4, None)])
    found = leak.contaminated(documents([(1, " ".join(passage + ["x"] * 5 + passage)), (2, " ".join(broken)), (3, " ".join(passage[:12])), (4, " ".join(passage[:10]))]), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_words, r.score, r.places) for r in found} == {(1, 1, 20, 20, 2), (2, 1, 20, 17, 1), (3, 1, 20, 12, 1)}


def test_odd_rows_and_empty_tables(spark, documents):
    passage = " ".join(f"q{i}" for i in range(16))
    bench = benchmark_table(spark, [(1, passage)])
    rows = [(None, passage), (5, passage), (5, "nothing"), (5, passage), (6, None), (7, ""), (8, "?!"), (9, "w " * 40000 + passage)]
    found = leak.contaminated(documents(rows), bench).collect()
    assert {(r.doc_id, r.places) for r in found} == {(None, 1), (5, 1), (9, 1)}
    assert {r.doc_id for r in leak.clean_documents(documents(rows), bench).collect()} == {6, 7, 8}
    assert leak.contaminated(documents([]), bench).count() == 0
    nothing = benchmark_table(spark, [])
    assert leak.contaminated(documents(rows), nothing).count() == 0 and leak.clean_documents(documents(rows), nothing).count() == len(rows)


def test_join_without_broadcast_agrees(spark, documents, monkeypatch):
    passage = " ".join(f"q{i}" for i in range(30))
    bench, table = benchmark_table(spark, [(1, passage)]), documents([(i, f"a b c {passage} d" if i % 2 else "a b c d") for i in range(20)])
    first = sorted(leak.contaminated(table, bench).collect())
    monkeypatch.setattr(leak, "BROADCAST_SEEDS", 0)
    assert sorted(leak.contaminated(table, bench).collect()) == first and len(first) == 10


def counts(document, item):
    """Whether some alignment of two word lists holds a passage, with no masks."""
    n = len(item)
    if n < 9:
        return any(document[p:p + n] == item for p in range(len(document) - n + 1)) and (n > 3 or document == item)
    for shift in range(-n + 1, len(document)):
        points = [1 if document[j + shift] == item[j] else -2 for j in range(max(0, -shift), min(n, len(document) - shift))]
        run = best = 0
        for x in points:
            run = max(0, run) + x
            best = max(best, run)
        if best >= min(12, -(-55 * n // 100)) or any(sum(points[i:i + 13]) >= 7 for i in range(len(points) - 12)):
            return True
    return False


def test_agrees_with_all_alignments(spark, documents):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([1, 2, 3, 4, 5, 8, 9, 10, 13, 16, 22, 40, 60])}
    rows = {100 + i: list(w) for i, w in items.items()} | {200 + i: text(5) + w + text(5) for i, w in items.items()}
    for at in range(13):  # one substitution in thirteen words of a long item
        passage = items[12][20:33]
        passage[at] = "other"
        rows[300 + at] = text(rng.randint(0, 9)) + ["x", *passage, "y"] + text(3)
    for k in range(30):  # two in fifteen
        passage = items[11][5:20]
        for at in rng.sample(range(15), 2):
            passage[at] = "other"
        rows[400 + k] = ["x", *passage, "y"]
    bench = benchmark_table(spark, [(i, " ".join(w)) for i, w in items.items()])
    found = {(r.doc_id, r.item_id) for r in leak.contaminated(documents([(d, " ".join(w)) for d, w in rows.items()]), bench).collect()}
    assert found == {(d, i) for d, w in rows.items() for i, item in items.items() if counts(w, item)}
    assert {(200 + i, i) for i in (3, 4, 5)} <= found and {(300 + i, 12) for i in range(13)} <= found and not {(200 + i, i) for i in (0, 1, 2)} & found
