"""SimHash against brute force on planted and random fingerprints, and the near-copy filter."""

import random

import numpy as np
import xxhash

from ledgerloom.llm import queries, simhash
from ledgerloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    at = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, FOLDER).collect()}
    assert found == {d: (f"{fps[d]:016x}", at[d]) for d in fps}


def test_dense_groups_lose_no_link(spark):
    """Hundreds of fingerprints around few centres crowd the keys and need the finer ones."""
    rng = random.Random(3)
    fps = set()
    for centre in (rng.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(150):
            x = centre
            for b in rng.sample(range(24), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    links = simhash.hamming_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    assert all((signed(r.a) ^ signed(r.b)) & ((1 << 64) - 1) and ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    got = {r.node: r.component for r in components(links).collect()}
    sets = {}
    for f in fps:
        sets.setdefault(want[f], set()).add(signed(f))
    found = {}
    for f in fps:
        found.setdefault(got.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, found.values()))


def test_every_close_pair_shares_a_key_on_each_level():
    rng = np.random.default_rng(1)
    for finer in simhash._levels():
        for above, masks in list(finer.items())[:40]:
            inside = simhash._bits_of(above % (1 << 64)) if above is not None else list(range(64))
            for _ in range(20):
                difference = sum(1 << int(b) for b in rng.choice(inside, 3, replace=False))
                assert any(difference & ~(m % (1 << 64)) == 0 for m in masks)


def test_odd_rows(spark, documents):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "A b"), (5, "a B"), (None, "a b"), (7, "x y z"), (7, "x y z"), (8, long), (9, long.upper())]
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(simhash.fingerprints(documents(rows))).collect()}
    by_id = {d: (f, c) for d, f, c in found}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert by_id[4] == by_id[5] == by_id[None] and by_id[4][1] == 4
    assert by_id[7][1] == 7 and by_id[8] == by_id[9] == (f"{plain_fingerprint(long):016x}", 8)
    assert simhash.near_duplicates(simhash.fingerprints(documents([]))).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 300)] + [(1000 + i, 999) for i in range(1, 200)] + [(5000, 5000), (None, 3), (7000, 6000), (6000, 7000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 301)) and all(found[1000 + i] == 999 for i in range(1, 200))
    assert found[5000] == 5000 and found[7000] == found[6000] == 6000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(400)] for _ in range(12)]
    rows = [(100 * i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in range(1, 6):
            w = list(b)
            for at in rng.sample(range(400), k % 4):  # up to three substituted words
                w[at] = word()
            rows.append((100 * i + k, " ".join(w).title() if k == 3 else " ".join(w)))
        rows.append((100 * i + 50, " ".join(word() for _ in range(300))))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "two"), (5004, "Two")]
    prints = {d: plain_fingerprint(t or "") for d, t in rows}
    want = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert 30 < len(set(want.values())) < len(rows)
    table = documents(rows + [(None, rows[0][1]), (0, rows[0][1]), (700, rows[100 // 50][1])])
    found = simhash.without_near_copies(table)
    assert found.columns == table.columns
    kept = sorted((r.doc_id for r in found.collect()), key=str)
    assert kept == sorted([*set(want.values()), None], key=str)
    assert {r.doc_id: r.text for r in found.collect() if r.doc_id is not None}.items() <= dict(rows).items()
    assert simhash.without_near_copies(documents([])).count() == 0
