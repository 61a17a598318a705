"""Line dedup: patience matches, planted blocks, hot lines, odd rows."""

import random

from ledgerloom.llm import line_dedup as lines


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_matches():
    rng = random.Random(7)
    for _ in range(500):
        a, b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))], [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        found = lines.patience_matches(a, b)
        assert all(a[x] == b[y] for x, y in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) <= plain_lcs(a, b)
    for _ in range(200):  # all lines unique: the anchors are a longest common subsequence
        a, b = rng.sample(range(30), 15), rng.sample(range(30), 15)
        assert len(lines.patience_matches(a, b)) == plain_lcs(a, b)
    assert lines.patience_matches([1, 2, 2, 3], [9, 1, 2, 2, 3]) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert lines.blocks([(0, 0), (1, 1), (5, 3)], [4, 4, 1, 9], 8) == [0, 1, 3]


def test_planted_blocks(spark, documents):
    line = lambda tag, k: " ".join(f"{tag}{k}w{j}" for j in range(8))
    passage = [line("p", k) for k in range(3)]
    rows = [(1, "\n".join([line("a", 0), *passage, line("a", 1)])), (2, "\n".join([line("b", 0), "  " + passage[0] + " ", *passage[1:], line("b", 1)])),
            (3, "\n".join(passage)), (4, "\n".join([line("c", k) for k in range(5)])), (5, "\n".join(["tiny line here", line("d", 1)])),
            (6, "\n".join(["tiny line here", line("e", 1)])), (7, "\n".join([passage[1], line("f", 1)]))]
    found = {r.doc_id: (r.n_lines, r.n_deleted, r.kept_text) for r in lines.line_dedup(documents(rows)).collect()}
    text = dict(rows)
    assert {d for d, x in found.items() if x[1] == 0} == {1, 4, 5, 6, 7}  # a single line of eight words is no block of ten
    assert found[1][2] == text[1]
    assert found[2] == (5, 3, "\n".join([line("b", 0), line("b", 1)])) and found[3] == (3, 3, "")


def test_frequent_lines_link_every_holder(spark, documents):
    block = " ".join(f"h{j}" for j in range(30))
    rows = [(i, f"{block}\nown {i} " + " ".join(f"x{i}y{j}" for j in range(6))) for i in range(200)]
    found = {r.doc_id: r.n_deleted for r in lines.line_dedup(documents(rows)).collect()}
    assert found == {i: int(i > 0) for i in range(200)}
    pairs = lines.candidate_pairs(lines.hashed_lines(documents(rows)))
    assert 199 <= pairs.count() <= 2 * 200


def test_odd_rows(spark, documents):
    block = " ".join(f"z{j}" for j in range(12))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, block), (5, block), (5, block), (None, block), (6, "\n".join([block] * 500)), (7, "\n".join(f"{block} {i}" for i in range(5000)))]
    found = {r.doc_id: (r.n_lines, r.n_deleted) for r in lines.line_dedup(documents(rows)).collect()}
    assert found[1] == found[2] == (1, 0) and found[3] == (3, 0) and found[4] == (1, 0) and found[5][0] == 2 and found[5][1] >= 1
    assert found[7] == (5000, 0) and found[6][1] >= 1 and set(found) == {None, *range(1, 8)} and found[None] == (1, 0)
    assert lines.line_dedup(documents([])).count() == 0


def test_passages_of_hot_lines_with_different_first_holders(spark, documents):
    one, two = " ".join(f"p{j}" for j in range(7)), " ".join(f"q{j}" for j in range(7))
    short = "\n".join(f"s{k} t{k} u{k}" for k in range(4))  # twelve words in lines of three
    rows = [(1, f"{one}\na1"), (2, f"{two}\na2"), *((i, f"own {i}\n{one}\n{two}\nend {i}") for i in range(3, 120)),
            *((i, f"own {i}\n{short}\nend {i}") for i in range(200, 260))]
    found = {r.doc_id: r.n_deleted for r in lines.line_dedup(documents(rows)).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 200: 0} | {i: 2 for i in range(4, 120)} | {i: 4 for i in range(201, 260)}


def test_runs_cover_every_line_of_a_block():
    import numpy as np
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([0, 1, 3, 6, 12]) for _ in range(rng.randint(1, 8))]
        hashes = [rng.getrandbits(62) + 1 if w else 0 for w in words]
        runs = lambda h, w: set(lines.run_hashes(np.array(h, np.int64), np.array(w, np.int64), 10).tolist())
        other = runs([5, *hashes, 6], [4, *words, 4])
        assert runs(hashes, words) <= other and bool(runs(hashes, words)) == (sum(words) >= 10)


def test_repeated_passages_go_on_either_side(spark, documents):
    x, y, u, v, w, p, q = range(1, 8)
    once, twice = [x, p, q, y], [u, p, q, v, p, q, w]
    assert lines.marked(once, twice, [6] * 7, 10) == [1, 2, 4, 5] and lines.marked(twice, once, [6] * 4, 10) == [1, 2]
    assert lines.marked([p] * 3, [p] * 500, [6] * 500, 10) == list(range(500))
    rng = random.Random(4)
    for _ in range(300):  # few different lines: the heaviest common run is found
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))], [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        most = max(k for k in range(13) if any(a[i:i + k] == b[j:j + k] and len(a[i:i + k]) == k for i in range(len(a) + 1) for j in range(len(b) + 1)))
        i, j, n = lines._heaviest_run(a, b, list(range(len(b) + 1)), 0, len(a), 0, len(b))
        assert n == most and a[i:i + n] == b[j:j + n]
    line = {k: " ".join(f"{k}w{j}" for j in range(6)) for k in "xypquvw"}
    rows = [(1, "\n".join(line[k] for k in "xpqy")), (2, "\n".join(line[k] for k in "upqvpqw"))]
    assert {r.doc_id: r.n_deleted for r in lines.line_dedup(documents(rows)).collect()} == {1: 0, 2: 4}


def test_blocks_in_another_order_go(spark, documents):
    assert lines.marked([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3], [6] * 7, 10) == [0, 1, 2, 4, 5, 6]
    rng = random.Random(9)
    for _ in range(100):  # blocks of distinct lines, shuffled: all of them go and nothing else does
        parts = [[10 * k + j for j in range(3)] for k in range(6)]
        second = [[*part, 1000 + k] for k, part in enumerate(rng.sample(parts, 6))]
        flat = [x for part in second for x in part]
        assert lines.marked(sum(parts, []), flat, [5] * len(flat), 10) == [j for j, x in enumerate(flat) if x < 1000]


def test_agrees_with_all_pairs(spark):
    """Every pair of documents aligned, on the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(lines.hashed_lines(docs).collect())
    want = {r.doc_id: set() for r in rows}
    for k, later in enumerate(rows):
        known = set(later.hashes) - {0}
        for first in rows[:k]:
            if not known.isdisjoint(first.hashes):
                want[later.doc_id].update(lines.marked(first.hashes, later.hashes, later.words, lines.BLOCK_WORDS))
    found = {r.doc_id: set(r.deleted) for r in lines.deletions(docs).collect()}
    assert found == {d: x for d, x in want.items() if x}
