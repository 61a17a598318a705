"""Hard negatives by windowed inner products, searched in cover trees.

For an anchor and one of its positives the wanted negatives are the rows of other labels whose inner
product lies in a window below the positive's, best first. Vectors are integers, so scores are exact.

Every row is a candidate. A further component gives all candidates the same norm, which leaves inner
products with a query unchanged and makes the largest product the nearest point of a sphere.

* Rows are dealt to cells around centres from a bounded sample (the top level), cells with many rows
  are cut by a hash of the id, and each part becomes a cover tree of bounded size in one task.
* A tree's levels are nets: centres are taken farthest first, so on every level all points lie within
  the level's covering radius of their centre and centres are at least that far apart. Each node keeps
  the radius that its own points need.
* A radius bounds the inner products of a query with all points below the node, from above and from
  below. A block of queries goes down a tree best-first: the open node with the largest bound comes
  next, queries leave it whose windows lie outside its bounds or are filled with better rows, and the
  points of a leaf are scored exactly.
* A query first searches the tree that holds it. What it finds there bounds the search of all others.

Caps are only on what a task holds (rows of a tree, queries of a block); results are exact.

Nulls and odd rows: rows with a null id, label or vector or with a null or non-finite component take no
part; of vectors with different numbers of components those with the most frequent number take part
(the smaller one of equals); rows that share an id are one row (the smallest label, then vector); an
anchor with fewer positives or negatives than asked gets all; equal scores go to the smaller id; a
vector whose scores do not fit 64 bits is an error; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.llm.tables import unit_hash
from ledgerloom.scratch import materialise


@dataclass(frozen=True)
class Settings:
    """Bounds on what a task holds."""

    tree_rows: int = 4096    # rows of a tree, about
    leaf_rows: int = 64
    fanout: int = 8          # centres per node and level
    cells: int = 512         # cells of the top level at most
    sample: int = 4096       # rows that the centres are taken from, about
    block: int = 2048        # queries that search a tree together, about


NODE = np.dtype([("centre", "<i4"), ("low", "<i4"), ("high", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])
TREE = "tree long, ids binary, labels binary, points binary, nodes binary"
FOUND = "anchor_id long, window int, vec_id long, score long"
EXACT = float(1 << 53)  # doubles hold all integers up to here
LARGEST = 1 << 62       # scores are at most this large
NONE = -LARGEST - 1     # less than any score


# ---------------------------------------------------------------- rows

def usable(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v: array<long>) of the rows that take part; components become floor(scale x)."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(sound)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    rows = materialise(rows, "negatives-rows")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def on_sphere(v: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that makes their squared norm ``longest``."""
    v = v.astype(float)
    return np.c_[v, np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))]


def farthest_first(points: np.ndarray, most: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, nearest centre of each point, distance to it); stops when all points are centres' copies."""
    centres = [first]
    near, distance = np.zeros(len(points), int), np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    while len(centres) < most:
        next_ = int(distance.argmax())
        if distance[next_] <= 0:
            break
        to_next = np.sqrt(((points - points[next_]) ** 2).sum(axis=1))
        closer = to_next < distance
        near[closer], distance[closer] = len(centres), to_next[closer]
        centres.append(next_)
    return np.array(centres), near, distance


# ---------------------------------------------------------------- trees

def build_tree(v: np.ndarray, longest: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes): a node's points are rows low to high of that order, node 0 holds all."""
    points, order, nodes = on_sphere(v, longest), np.arange(len(v)), []
    nodes.append([0, 0, len(v), 0, 0, float(np.sqrt(((points - points[0]) ** 2).sum(axis=1)).max())])
    at = 0
    while at < len(nodes):
        centre, low, high, _, _, radius = nodes[at]
        if high - low > s.leaf_rows and radius > 0:
            rows = order[low:high].copy()
            centres, near, distance = farthest_first(points[rows], s.fanout, int(np.flatnonzero(rows == centre)[0]))
            sort = np.argsort(near, kind="stable")
            order[low:high] = rows[sort]
            sizes = np.bincount(near, minlength=len(centres))
            nodes[at][3:5] = len(nodes), len(centres)
            begin = low
            for c, size in enumerate(sizes):
                nodes.append([int(rows[centres[c]]), begin, begin + int(size), 0, 0, float(distance[near == c].max())])
                begin += int(size)
        at += 1
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    return order, np.array([(place[c], *rest) for c, *rest in nodes], NODE)


def search_tree(ids, labels, v, nodes, longest, queries, query_ids, query_labels, low, high, least, keep, same_label):
    """(query row, window, id, score) of the best ``keep`` rows per query and window in this tree.

    ``low`` and ``high`` (queries, windows) bound the scores that a window takes, ``least`` is a score
    that ``keep`` rows elsewhere reach already. Scores below it are not returned; equal ones are.
    """
    exact = float if longest < EXACT else np.int64
    v, q = v.astype(exact), queries.astype(exact)
    centres = on_sphere(v[nodes["centre"]], longest)
    flat, norms = queries.astype(float), np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    slack = 1e-9 * (longest + 1) + 1e-6
    best = np.full((*low.shape, keep), NONE)
    best_ids = np.zeros((*low.shape, keep), np.int64)
    floor = np.maximum(low, least)

    def bounds(rows, of):
        """Of the products of queries ``rows`` with the points below nodes ``of``: (from below, from above)."""
        c, r = centres[of], nodes["radius"][of][None, :]
        product, n = flat[rows] @ c[:, :-1].T, norms[rows][:, None]
        apart = np.sqrt(np.maximum(0.0, n * n + longest - 2 * product))  # distance of the query and the centre
        half = (n * n + longest) / 2
        above = np.minimum(product + n * r, half - np.maximum(0.0, apart - r) ** 2 / 2)
        return np.maximum(product - n * r, half - (apart + r) ** 2 / 2) - slack, above + slack

    def wanted(rows, below, above):
        """Which queries have a window that may take something between these bounds."""
        return ((below[:, None] <= high[rows]) & (above[:, None] >= floor[rows])).any(axis=1)

    everyone = np.arange(len(q))
    below, above = (x[:, 0] for x in bounds(everyone, np.array([0])))
    open_, count = [(-above.max(initial=-np.inf), 0, 0, everyone, below, above)], 0
    while open_:
        _, _, node, rows, below, above = heapq.heappop(open_)
        still = wanted(rows, below, above)
        rows = rows[still]
        if not len(rows):
            continue
        _, start, end, child, children, _ = nodes[node]
        if children:
            of = np.arange(child, child + children)
            lower, upper = bounds(rows, of)
            for k, one in enumerate(of):
                some = wanted(rows, lower[:, k], upper[:, k])
                if some.any():
                    count += 1
                    heapq.heappush(open_, (-upper[some, k].max(), count, int(one), rows[some], lower[some, k], upper[some, k]))
            continue
        scores = (q[rows] @ v[start:end].T).astype(np.int64)
        other = (labels[None, start:end] == query_labels[rows][:, None]) == same_label
        other &= ids[None, start:end] != query_ids[rows][:, None]
        for w in range(low.shape[1]):
            fits = other & (scores >= floor[rows, w][:, None]) & (scores <= high[rows, w][:, None])
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            at = rows[some]
            all_scores = np.c_[best[at, w], np.where(fits[some], scores[some], NONE)]
            all_ids = np.c_[best_ids[at, w], np.broadcast_to(ids[start:end], (len(some), end - start))]
            first = np.lexsort((all_ids, -all_scores), axis=-1)[:, :keep]
            best[at, w], best_ids[at, w] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_ids, first, 1)
            floor[at, w] = np.maximum(floor[at, w], best[at, w, -1])
    row, window, place = np.nonzero(best > NONE)
    return row, window, best_ids[row, window, place], best[row, window, place]


# ---------------------------------------------------------------- tables

def plant(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, float]:
    """(trees, (vec_id, label, v, tree) of all rows, squared norm that the further component fills up to)."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()
    longest = float(longest or 0)
    if longest >= LARGEST:
        raise ValueError("scores of these vectors do not fit 64 bits")
    kind = "<i4" if longest < EXACT else "<i8"
    share = min(1.0, s.sample / max(1, n))
    sample = np.array([r.v for r in rows.where(unit_hash("vec_id", 23) < share).orderBy("vec_id").select("v").collect()] or [[0]], np.int64)
    centres = on_sphere(sample, longest)
    centres = centres[farthest_first(centres, max(1, min(s.cells, -(-n // s.tree_rows))))[0]]

    def to_cells(batches):
        for batch in batches:
            points = on_sphere(_matrix(batch.column("v"), np.int64), longest)
            cell = np.concatenate([(points[a:a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(points), 4096)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "label", "v", "cell"])

    in_cells = materialise(rows.mapInArrow(to_cells, "vec_id long, label long, v array<long>, cell long"), "negatives-cells")
    sizes = in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row per cell: at most ``cells``
    parts = F.ceil(F.col("n") / s.tree_rows)
    first = F.sum(parts).over(W.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("cell", parts.alias("parts"), F.coalesce(first, F.lit(0)).alias("first"))
    tree = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("long")
    placed = in_cells.join(F.broadcast(sizes), "cell").select("vec_id", "label", "v", tree.alias("tree"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = _matrix(table["v"], np.int64)
        order, nodes = build_tree(v, longest, s)
        held = [table["vec_id"].to_numpy()[order].astype("<i8"), table["label"].to_numpy()[order].astype("<i8"), v[order].astype(kind), nodes]
        return pa.table({"tree": table["tree"].slice(0, 1), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "labels", "points", "nodes"), held)}})

    placed = materialise(placed, "negatives-placed")
    return materialise(placed.groupBy("tree").applyInArrow(build, TREE), "negatives-trees"), placed, longest


def search(trees: DataFrame, queries: DataFrame, longest: float, keep: int, same_label: bool, blocks: int) -> DataFrame:
    """(anchor_id, window, vec_id, score): the best ``keep`` per tree and query of (tree, anchor_id, label, v, low, high, least)."""
    kind = "<i4" if longest < EXACT else "<i8"

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table({"anchor_id": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        tree = left.to_pylist()[0]
        ids, labels = (np.frombuffer(tree[c], "<i8") for c in ("ids", "labels"))
        points, nodes = np.frombuffer(tree["points"], kind).reshape(len(ids), -1), np.frombuffer(tree["nodes"], NODE)
        anchors = right["anchor_id"].to_numpy()
        limits = [_matrix(right[c], np.int64) for c in ("low", "high", "least")]
        row, window, found, scores = search_tree(ids, labels, points, nodes, longest, _matrix(right["v"], np.int64), anchors,
                                                 right["label"].to_numpy(), *limits, keep, same_label)
        return pa.table({"anchor_id": anchors[row], "window": pa.array(window, pa.int32()), "vec_id": found, "score": scores})

    block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks))
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).groupBy("tree", "block")
    return left.cogroup(queries.withColumn("block", block).groupBy("tree", "block")).applyInArrow(find, FOUND)


def best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each (anchor_id, window), with their rank."""
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def windowed_search(trees: DataFrame, queries: DataFrame, longest: float, keep: int, same_label: bool, s: Settings) -> DataFrame:
    """The best ``keep`` of all rows per window of ``queries`` (anchor_id, label, v, tree, low, high), with their rank.

    First the tree that holds the query, then all others with what was found as a bound.
    """
    blocks = max(1, -(-queries.count() // s.block))
    least = F.transform("low", lambda _: F.lit(NONE))
    own = materialise(search(trees, queries.withColumn("least", least), longest, keep, same_label, blocks), "negatives-own")
    reached = best(own, keep).where(F.col("rank") == keep).groupBy(F.col("anchor_id").alias("_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_reached"))  # as many as windows
    least = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("_reached", i.cast("int")), F.lit(NONE)))
    bounded = queries.join(reached, F.col("anchor_id") == F.col("_id"), "left").withColumn("least", least).drop("_id", "_reached")
    every = trees.select(F.col("tree").alias("_tree"), F.pmod(F.xxhash64("tree"), F.lit(8)).alias("_salt"))
    salted = materialise(bounded, "negatives-queries").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    others = salted.join(every, "_salt").where("tree <> _tree").drop("tree", "_salt").withColumnRenamed("_tree", "tree")
    return best(own.union(search(trees, others, longest, keep, same_label, blocks)), keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90,
                   settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, v).

    The positives of an anchor are the best rows of its label; the negatives of a positive the best rows of
    other labels with low_share x positive <= 100 x negative <= high_share x positive.
    """
    trees, placed, longest = plant(rows, settings)
    anchors = materialise(placed.where(is_anchor).withColumnRenamed("vec_id", "anchor_id"), "negatives-anchors")
    anywhere = anchors.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(LARGEST))})
    chosen = windowed_search(trees, anywhere, longest, positives, True, settings)
    chosen = materialise(chosen.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
                                       F.col("score").alias("positive_score")), "negatives-positives")
    share = partial(_share, F.col("positive_score"))
    windows = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", share(low_share, True).alias("low"),
                                                                                     share(high_share, False).alias("high")))).alias("w"))
    # Windows of an anchor with fewer positives are filled up with empty ones, so that all have as many.
    filled = F.sequence(F.lit(0), F.lit(positives - 1))
    limit = {side: F.transform(filled, lambda i: F.coalesce(F.try_element_at(F.col("w"), i.cast("int") + 1)[side], F.lit(empty)))  # noqa: B023
             for side, empty in (("low", LARGEST + 1), ("high", NONE))}
    queries = anchors.join(windows, "anchor_id").withColumns(limit).drop("w")
    found = windowed_search(trees, queries, longest, negatives, False, settings)
    return found.join(chosen, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent x score / 100 rounded up or down, in whole numbers."""
    product = score.cast("decimal(38,0)") * percent
    return (F.ceil(product / 100) if up else F.floor(product / 100)).cast("long")
