"""The neighbour graph against brute force: recall, exact scores, copies, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours, queries

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, node long, score double"


def brute(ids, x, query, k):
    score = x.astype(float) @ x[ids.index(query)].astype(float)
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-score[i], ids[i]))
    return [(ids[i], float(score[i])) for i in order[:k]]


def test_recall_of_the_query(spark):
    rows = sorted(spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect())
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    found = {}
    for r in queries.op1_neighbours(spark, FOLDER).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits, wanted = 0, [i for i in ids if i % 20 == 0]
    assert sorted(found) == wanted
    for q in wanted:
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(abs(s - x[ids.index(q)].astype(float) @ x[ids.index(v)].astype(float)) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & {v for v, _ in brute(ids, x, q, 20)})
    assert hits >= 0.95 * 20 * len(wanted)


def test_different_lengths_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.2, 3, size=(300, 1))
    x[100:200] = x[100]  # a third of the table is one vector
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0, 7, 0.5) for i in range(300)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(1000 + 20 * k, v, 0, 7, 0.5) for k, v in enumerate(odd)] + [(None, [1.0] * 8, 0, 7, 0.5)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 300, 20))
    hits = 0
    for q, got in found.items():
        want = brute(list(range(300)), x, q, 20)
        assert len(got) == 20
        hits += len({v for _, v, _ in got} & {v for v, _ in want})
    assert hits >= 0.95 * 20 * len(found)
    assert [v for _, v, _ in sorted(found[100])][:5] == [v for v, _ in brute(list(range(300)), x, 100, 5)]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(20 * i, [1.0, float(i)], 0, 0, 0.0) for i in range(3)], SCHEMA)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(few, F.lit(True), 20).collect())
    assert found == [(0, 1, 20, 1.0), (0, 2, 40, 1.0), (20, 1, 40, 3.0), (20, 2, 0, 1.0), (40, 1, 20, 3.0), (40, 2, 0, 1.0)]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.nearest(few.limit(1), F.lit(True)).count() == 0
