"""Hard negatives against all pairs: the query and its SQL, small trees and blocks, bounds, hot vectors, odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as hard, queries
from ledgerloom.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int, score double, tree long, low string"


def plain(rows, anchors, positives=5, negatives=10):
    """All pairs; rows: {id: (label, vector of ints)}."""
    out = []
    for a in anchors:
        label, q = rows[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(-t, i) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


def ints(v):
    return [int(np.floor(256 * float(x))) for x in v]


def test_the_query_and_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = queries.op12_hard_negatives(spark, folder)
    got = sorted(tuple(r) for r in found.collect())
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op12_hard_negatives']})").fetchall()
    assert len(got) > 100 and got == sorted(want)
    table = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, ints(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    assert got == plain(table, [i for i in sorted(table) if i % 100 == 0])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 6))
    x[300:600] = x[300]  # a third of the table is one vector, under all labels
    x[600:640] = 0
    return {i: (int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)}


def test_small_trees_and_blocks_change_nothing(spark, clustered):
    table = spark.createDataFrame([(i, v, label, 0.0, 1, "x") for i, (label, v) in clustered.items()], SCHEMA)
    rows = hard.usable(table, F.col("label"))
    whole = {i: (label, ints(v)) for i, (label, v) in clustered.items()}
    want = plain(whole, [i for i in whole if i % 30 == 0])
    small = hard.Settings(tree_rows=50, leaf_rows=4, fanout=3, cells=6, sample=100, block=7)
    for settings in (small, hard.Settings()):
        found = hard.hard_negatives(rows, F.col("vec_id") % 30 == 0, settings=settings)
        assert sorted(tuple(r) for r in found.collect()) == want


def test_trees_cover_separate_and_bound(clustered):
    s = hard.Settings(leaf_rows=8, fanout=4)
    v = np.array([ints(v) for _, v in clustered.values()])
    longest = float((v.astype(float) ** 2).sum(axis=1).max())
    order, nodes = hard.build_tree(v, longest, s)
    points = hard.on_sphere(v[order], longest)
    assert sorted(order) == list(range(len(v))) and np.allclose((points ** 2).sum(axis=1), longest)
    leaves = []
    for centre, low, high, child, children, radius in nodes.tolist():
        apart = np.sqrt(((points[low:high] - points[centre]) ** 2).sum(axis=1))
        assert apart.max() <= radius + 1e-6 and low <= centre < high
        below = nodes[child:child + children]
        if children:
            assert below["low"][0] == low and below["high"][-1] == high and (below["low"][1:] == below["high"][:-1]).all()
            between = np.sqrt(((points[below["centre"]][:, None] - points[below["centre"]][None]) ** 2).sum(axis=2)) + np.eye(children) * 1e9
            assert between.min() >= below["radius"].max() - 1e-6  # a net: separated by the covering radius
        else:
            leaves.append(high - low)
    assert sum(leaves) == len(v) and len(nodes) < len(v) // 2


def test_most_nodes_are_skipped(clustered, monkeypatch):
    """In clustered data the bounds spare most of the exact products."""
    v = np.array([ints(v) for _, v in clustered.values()])
    longest = float((v.astype(float) ** 2).sum(axis=1).max())
    order, nodes = hard.build_tree(v, longest, hard.Settings(leaf_rows=16, fanout=4))
    lexsort = np.lexsort
    scored = []
    monkeypatch.setattr(hard.np, "lexsort", lambda keys, axis: scored.append(keys[0].shape[0] * (keys[0].shape[1] - 5)) or lexsort(keys, axis=axis))
    hard.search_tree(order.astype(np.int64), np.zeros(len(v), np.int64), v[order], nodes, longest, v[:1], np.array([0]), np.array([0]),
                     np.array([[hard.NONE]]), np.array([[hard.LARGEST]]), np.array([[hard.NONE]]), 5, True)
    assert 0 < sum(scored) < len(v) // 4


def test_odd_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, [0.5, -0.5], 2), (3, [0.5, -0.5], 2), (200, [-1.0, 0.0], 3), (300, None, 1),
            (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (8, [0.5], 2), (9, [], 2)]
    table = spark.createDataFrame([(i, v, label, 0.0, 1, "x") for i, v, label in rows], SCHEMA)
    found = sorted(tuple(r) for r in hard.hard_negatives(hard.usable(table, F.col("label")), F.col("vec_id") % 100 == 0).collect())
    assert found == [(100, 1, 1, 2, 256 * 230, 256 * 128), (100, 1, 2, 3, 256 * 230, 256 * 128)]
    empty = hard.usable(table.where("vec_id = 12345"), F.col("label"))
    assert hard.hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    large = spark.createDataFrame([(i, [3.0e5 * (i + 1), 7.0 + i], i % 2, 0.0, 1, "x") for i in range(20)], SCHEMA)
    whole = {i: (i % 2, ints([3.0e5 * (i + 1), 7.0 + i])) for i in range(20)}
    found = hard.hard_negatives(hard.usable(large, F.col("label")), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == plain(whole, [0, 10])
    with pytest.raises(ValueError, match="64 bits"):
        hard.hard_negatives(hard.usable(large.withColumn("embedding", F.array(F.lit(1e10), F.lit(1.0))), F.col("label")), F.lit(True))
