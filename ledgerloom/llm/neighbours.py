"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

Vectors get one more component so that all have the same length; the inner product with a query,
whose further component is zero, is unchanged, and largest inner products are nearest neighbours.
Equal vectors are one node of the graph; a node remembers its smallest ids.

* The graph starts from random hyperplane cells: vectors with the same signs of a few projections
  are compared in blocks of bounded size, several times with other projections.
* Each round of NN-descent joins neighbours of neighbours: every node brings together the nodes
  that point at it or that it points at, these are compared with one another, and each keeps its
  best. It ends when few lists still change.
* A query walks the graph: it starts from a few common nodes and, if it is a vector of the table,
  from its own, and per round joins the best unvisited nodes of its beam with their neighbours,
  scores the new ones and keeps the best, until the beam has no unvisited node.

All rows are in the graph. Neighbour lists, beams, blocks and common nodes have fixed sizes, so that
every join's rows are in proportion to the vectors or the queries; recall is measured against brute
force in the tests.

Nulls and odd rows: vectors that are null, empty, zero or hold a null or a non-finite component take
no part, neither as query nor as candidate, nor do rows without an id; of vectors with different
numbers of components those with the most frequent number take part (the smaller one of equals);
rows that share an id are one vector (the smallest); a query with fewer candidates than asked gets
all that exist; equal scores go to the smaller id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.scratch import materialise


@dataclass(frozen=True)
class Settings:
    """Sizes of the index; all are bounds per node, query or task."""

    degree: int = 32         # neighbours that a node keeps
    both_ways: int = 64      # neighbours of a node counting those that point at it
    starts: int = 12         # rounds of random cells
    cell: int = 2048         # vectors that are compared with one another in a cell
    rounds: int = 4          # rounds of NN-descent at most
    settled: float = 0.05    # share of changed list entries at which it ends
    offers: int = 6          # best partners that a node hears of per common neighbour
    common: int = 64         # nodes from which every query may start
    beam: int = 128          # best nodes that a query keeps
    expand: int = 40         # nodes that a query visits per round
    walks: int = 12          # rounds of the search at most
    seed: int = 11


# ---------------------------------------------------------------- nodes

def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec: array<double>) of the vectors that take part."""
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(sound).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = materialise(rows, "ann-vectors")
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("vec") == (sizes["n"] if sizes else 0))


def nodes_and_members(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, blob) per distinct vector and (node, vec_id) with its ``most`` smallest ids; node is the smallest.

    The rank keeps ``most`` rows per vector and task before the shuffle, so a vector that fills a
    third of the table is not gathered.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).where(F.col("_rank") <= most)
    ranked = ranked.withColumn("node", F.min("vec_id").over(W.partitionBy("vec")))
    ranked = materialise(ranked.select("node", "vec_id", "vec", "_rank"), "ann-members")
    longest = ranked.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0]

    def blobs(batches):
        for batch in batches:
            v = _matrix(batch.column("vec"))
            rest = np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))
            x = (np.c_[v, rest] / np.sqrt(longest)).astype("<f2")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "blob"])

    nodes = ranked.where("_rank = 1").select("node", "vec").mapInArrow(blobs, "node long, blob binary")
    return materialise(nodes, "ann-nodes"), ranked.select("node", "vec_id")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _blobs(column) -> np.ndarray:
    """Half-precision vectors of a column of blobs, in single precision."""
    joined = b"".join(column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column))
    return np.frombuffer(joined, "<f2").astype(np.float32).reshape(len(column), -1)


# ---------------------------------------------------------------- the graph

def _best(similarity: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` largest entries per row."""
    k = min(k, similarity.shape[1] - 1)
    return np.argpartition(-similarity, k, axis=1)[:, :k] if k > 0 else np.zeros((len(similarity), 0), int)


def _partners(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, similarity) of each row's ``k`` nearest in the block."""
    similarity = x @ x.T
    np.fill_diagonal(similarity, -np.inf)
    best = _best(similarity, k)
    rows = np.repeat(np.arange(len(ids)), best.shape[1])
    others = best.ravel()
    # Summed pair by pair, so that a pair has the same similarity in every block and either order.
    return ids[rows], ids[others], (x[rows] * x[others]).sum(axis=1)


def _as_offers(node, other, similarity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(similarity, pa.float32())],
                                      names=["node", "other", "similarity"])


OFFER = "node long, other long, similarity float"


def _groups(batches, key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in sorted batches, as frames."""
    held = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for low, high in zip(np.r_[0, cuts[:-1]], cuts) if len(cuts) else ():
            yield frame.iloc[low:high]
        held = frame.iloc[cuts[-1]:] if len(cuts) else frame
    if held is not None and len(held):
        yield held


def _kept(offers: DataFrame, k: int) -> DataFrame:
    """(node, other, similarity): the ``k`` best different partners per node."""
    once = offers.groupBy("node", "other").agg(F.max("similarity").alias("similarity"))
    order = W.partitionBy("node").orderBy(F.desc("similarity"), "other")
    return once.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def first_graph(nodes: DataFrame, n: int, s: Settings) -> DataFrame:
    """Partners found in random hyperplane cells."""
    planes = max(0, int(np.ceil(np.log2(max(1, n) / (s.cell / 2)))))

    def cells(batches):
        for batch in batches:
            x, ids = _blobs(batch.column("blob")), batch.column("node")
            for start in range(s.starts):
                normal = np.random.default_rng([s.seed, start]).normal(size=(x.shape[1], max(1, planes))).astype(np.float32)
                signs = (x @ normal > 0)[:, :planes]
                code = signs @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), start)), pa.array(code.astype(np.int64)), ids, batch.column("blob")],
                                                 names=["start", "code", "node", "blob"])

    def compare(frame):
        node, other, similarity = _partners(frame["node"].to_numpy(), _blobs(frame["blob"]), s.degree // 2)
        return pd.DataFrame({"node": node, "other": other, "similarity": similarity})

    placed = nodes.mapInArrow(cells, "start long, code long, node long, blob binary")
    placed = materialise(placed, "ann-cells")
    sizes = placed.groupBy("start", "code").agg(F.count(F.lit(1)).alias("_n"))
    block = F.pmod(F.xxhash64("node", "start"), F.ceil(F.col("_n") / s.cell))
    blocks = placed.join(sizes, ["start", "code"]).withColumn("block", block)
    return _kept(blocks.groupBy("start", "code", "block").applyInPandas(compare, OFFER), s.degree)


def both_ways(graph: DataFrame, most: int) -> DataFrame:
    """(node, other, similarity) with the edges of both directions, the best ``most`` per node."""
    return _kept(graph.union(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "similarity")), most)


def descend(graph: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """One round: the neighbours of each node are compared with one another and offered to each other."""
    def meet(batches):
        held, size = [], 0
        for group in _groups(batches, "node"):
            x, ids = _blobs(group["blob"]), group["other"].to_numpy()
            if len(ids) > 1:
                held.append(_partners(ids, x, s.offers))
                size += len(held[-1][0])
            if size > 50_000:
                yield _as_offers(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield _as_offers(*(np.concatenate(c) for c in zip(*held)))

    around = both_ways(graph, s.both_ways).select("node", "other")
    met = around.join(nodes.select(F.col("node").alias("other"), "blob"), "other").select("node", "other", "blob")
    offers = met.repartition("node").sortWithinPartitions("node", "other").mapInArrow(meet, OFFER)
    return _kept(graph.union(offers), s.degree)


def build_graph(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, other, similarity): the neighbour graph of ``nodes`` (node, blob)."""
    n = nodes.count()
    graph = materialise(first_graph(nodes, n, s), "ann-graph")
    for _ in range(s.rounds):
        better = materialise(descend(graph, nodes, s), "ann-graph")
        same = better.join(graph.select("node", "other"), ["node", "other"], "left_semi").count()
        changed = better.count() - same
        graph = better
        if changed <= s.settled * n * s.degree:
            break
    return graph


# ---------------------------------------------------------------- search

def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, node): the nodes in each query's beam when its walk has ended.

    ``queries`` has (query_id, vec, node), where node is the query's own node or null.
    """
    edges = materialise(both_ways(graph, s.both_ways).select("node", "other"), "ann-edges")
    common = nodes.orderBy(F.xxhash64(F.lit(s.seed), "node"), "node").limit(s.common).toPandas()
    common_ids, common_x = common["node"].to_numpy(), _blobs(common["blob"]) if len(common) else None

    def start(batches):
        for batch in batches:
            frame = {"query_id": [], "node": []}
            own = batch.column("node").to_pylist()
            q = _matrix(batch.column("vec"))
            near = np.argsort(-(np.c_[q, np.zeros(len(q))] @ common_x.T), axis=1, kind="stable")[:, :8] if len(common_ids) else np.zeros((len(q), 0), int)
            for i, query in enumerate(batch.column("query_id").to_pylist()):
                first = {*common_ids[near[i]].tolist(), *([own[i]] if own[i] is not None else [])}
                frame["query_id"] += [query] * len(first)
                frame["node"] += sorted(first)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in frame.items()})

    def score(batches):
        for batch in batches:
            q, x = _matrix(batch.column("vec")), _blobs(batch.column("blob"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array((q * x[:, :-1]).sum(axis=1))],
                                             names=["query_id", "node", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(nodes, "node").join(queries.select("query_id", "vec"), "query_id")
        return rows.select("query_id", "node", "vec", "blob").mapInArrow(score, "query_id long, node long, score double")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "node")
    beam = materialise(scored(queries.mapInArrow(start, "query_id long, node long")).withColumn("visited", F.lit(False)), "ann-beam")
    for _ in range(s.walks):
        fresh = beam.where("not visited").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= s.expand).select("query_id", "node")
        fresh = materialise(fresh, "ann-fresh")
        if fresh.isEmpty():
            break
        beam = beam.join(fresh.withColumn("_now", F.lit(True)), ["query_id", "node"], "left").withColumn(
            "visited", F.col("visited") | F.coalesce("_now", F.lit(False))).drop("_now")
        reached = fresh.join(edges, "node").select("query_id", F.col("other").alias("node")).distinct()
        reached = reached.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti")
        wider = beam.unionByName(scored(reached).withColumn("visited", F.lit(False)))
        beam = materialise(wider.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= s.beam).drop("_r"), "ann-beam")
    return beam.select("query_id", "node")


def nearest(vectors: DataFrame, is_query, k: int = 20, s: Settings = Settings(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` holds.

    Queries are rows of the table; scores are inner products of the original vectors in double
    precision; a query's own row is no candidate.
    """
    rows = usable(vectors, id_column, column)
    nodes, members = nodes_and_members(rows, k + 1)
    graph = build_graph(nodes, s)
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    named = rows.join(members.where("node = vec_id").select("node"), F.col("vec_id") == F.col("node")).select("node", F.col("vec").alias("_v"))
    asked = materialise(asked.join(named, F.col("vec") == F.col("_v"), "left").select("query_id", "vec", "node"), "ann-queries")
    found = materialise(search(asked, graph, nodes, s), "ann-found")

    def exact(batches):
        for batch in batches:
            q, x = _matrix(batch.column("q")), _matrix(batch.column("vec"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array((q * x).sum(axis=1))], names=["query_id", "node", "score"])

    vec_of = rows.select(F.col("vec_id").alias("node"), "vec")
    pairs = found.join(vec_of, "node").join(asked.select("query_id", F.col("vec").alias("q")), "query_id")
    scores = pairs.select("query_id", "node", "q", "vec").mapInArrow(exact, "query_id long, node long, score double")
    candidates = scores.join(members, "node").where("vec_id <> query_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (candidates.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
