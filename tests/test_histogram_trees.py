"""Histogram boosting against a plain one that looks at every row, and its stability."""

from datetime import date

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerloom.operators import histogram_trees
from ledgerloom.operators.histogram_trees import HistogramTrees, derivatives, picked

DAY = date(2011, 6, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 12, 900) / 4.0, rng.gamma(2, 2, 900).round(1), rng.integers(0, 2, 900), np.full(900, 3.0)]
    mean = np.exp(0.4 * x[:, 0] + 0.1 * x[:, 1] * x[:, 2])
    return x, mean, rng


@pytest.fixture(scope="module")
def table(spark, data):
    x, mean, rng = data
    y = np.where(rng.random(900) < 0.3, 0.0, mean * rng.gamma(2, 0.5, 900))
    rows = [(i, DAY, [float(v) for v in r], float(t), float(t > 1.5), float(t) + 0.1) for i, (r, t) in enumerate(zip(x, y))]
    made = spark.createDataFrame(rows, "customer_id long, cutoff date, x array<double>, y double, any double, positive double")
    return made.withColumn("features", array_to_vector("x")).persist()


def plain(x, y, loss, rounds, depth, step, penalty, least, start):
    """Greedy boosting over all values of all features."""
    f = np.full(len(y), start)
    for _ in range(rounds):
        g, h = derivatives(loss, y, f)
        add = np.zeros(len(y))

        def grow(rows, level):
            total = -g[rows].sum() / (h[rows].sum() + penalty)
            best = (1e-9, None)
            if level < depth:
                for c in range(x.shape[1]):
                    for cut in np.unique(x[rows, c])[:-1]:
                        left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                        if min(len(left), len(right)) < least:
                            continue
                        gain = sum(g[p].sum() ** 2 / (h[p].sum() + penalty) for p in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + penalty)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if best[1] is None:
                r = (y - f)[rows]
                add[rows] = np.sort(r)[(len(r) - 1) // 2] * step if loss == "absolute" else total * step  # the lower median
                return
            for part in best[1]:
                grow(part, level + 1)

        grow(np.arange(len(y)), 0)
        f = f + add
    return f


@pytest.mark.parametrize("loss,label", [("tweedie", "y"), ("logistic", "any"), ("gamma", "positive"), ("poisson", "y"), ("squared", "y"), ("absolute", "y")])
def test_same_trees_as_a_plain_search(table, data, loss, label):
    x = data[0]
    y = np.array([r[0] for r in table.orderBy("customer_id").select(label).collect()])
    rounds = 2 if loss == "absolute" else 5  # residuals at a median are zero but for rounding, so later signs differ
    model = HistogramTrees(loss, rounds, 2, 0.3, 1.0, 20, bins=255, store_every=2).fit(table, label, F.col("customer_id"))
    found = np.array([r[0] for r in model.margin(table, "f").orderBy("customer_id").select("f").collect()])
    want = plain(x, y, loss, rounds, 2, 0.3, 1.0, 20, model.start)
    assert found == pytest.approx(want, rel=1e-5, abs=1e-3 if loss == "absolute" else 1e-7)


def test_absolute_errors_fall(table):
    errors = [HistogramTrees("absolute", r, 3, 0.3, 1.0, 20).fit(table, "y", F.col("customer_id")).margin(table, "f")
              .select(F.avg(F.abs(F.col("y") - F.col("f")))).first()[0] for r in (1, 4, 12)]
    assert errors[0] > errors[1] > errors[2]


def test_stored_scores_tasks_and_reruns_change_nothing(table, monkeypatch):
    fits = []
    for every, small in ((3, 400_000), (100, 500), (1, 1000)):
        monkeypatch.setattr(histogram_trees, "SMALL_TASK", small)
        monkeypatch.setattr(histogram_trees, "BLOCK_ROWS", small)
        fits.append(HistogramTrees("tweedie", 7, 3, 0.2, 5.0, 15, row_share=0.7, column_share=0.6, store_every=every).fit(table, "y", F.col("customer_id")))
    for other in fits[1:]:
        assert (other.feature == fits[0].feature).all() and np.allclose(other.value, fits[0].value) and (other.threshold == fits[0].threshold).all()


def test_shares_limits_and_the_constant_feature(table):
    model = HistogramTrees("squared", 6, 3, 0.3, 1.0, 60, column_share=0.5).fit(table, "y", F.col("customer_id"))
    assert 3 not in model.feature and len({tuple(sorted(set(t[t >= 0]))) for t in model.feature}) > 1
    assert all(len(set(t[t >= 0])) <= 2 for t in model.feature)
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shares = [picked(keys, n, 0.82) for n in range(3)]
    assert all(abs(s.mean() - 0.82) < 0.02 for s in shares) and (shares[0] != shares[1]).any()
    heavy = HistogramTrees("logistic", 3, 3, 0.3, 1.0, 1, min_weight=30.0).fit(table, "any", F.col("customer_id"))
    light = HistogramTrees("logistic", 3, 3, 0.3, 1.0, 1).fit(table, "any", F.col("customer_id"))
    assert (heavy.feature >= 0).sum() < (light.feature >= 0).sum()


def test_one_label_and_no_rows(table):
    same = table.withColumn("one", F.lit(1.0))
    model = HistogramTrees("logistic", 2, 2).fit(same, "one", F.col("customer_id"))
    assert model.margin(same, "f").selectExpr("min(1 / (1 + exp(-f)))").first()[0] > 0.999
    with pytest.raises(ValueError, match="no training rows"):
        HistogramTrees("logistic", 2, 2).fit(same.filter("customer_id < 0"), "one", F.col("customer_id"))
    with pytest.raises(ValueError, match="positive mean"):
        HistogramTrees("tweedie", 2, 2).fit(same.withColumn("zero", F.lit(0.0)), "zero", F.col("customer_id"))


def test_wide_rows_are_not_moved_into_blocks(table, monkeypatch):
    """The stored rows were dealt anew, eight bytes a value, before they were packed in one."""
    monkeypatch.setattr(type(table), "repartition", lambda *_: pytest.fail("rows are moved"))
    assert len(HistogramTrees("squared", 2, 2).fit(table, "y", F.col("customer_id")).feature) == 2


def test_columns_of_a_block_lie_in_one_piece_and_only_allowed_ones_are_added_up(table):
    """Scoring jumped through rows of all columns, and columns that a round may not use were added up as well."""
    model = HistogramTrees("squared", 1, 2)
    cuts = model._cuts(table.select("x"), 4)
    blocks = model._blocks(table.selectExpr("x", "y", "customer_id AS k").coalesce(1), cuts)
    (bins, y, keys, f), = histogram_trees._unpacked(0.0, 4, blocks.collect())
    assert bins.flags.f_contiguous and bins.shape == (900, 4)
    x = np.array([r[0] for r in table.select("x").collect()])
    assert all((bins[:, c] == np.searchsorted(cuts[c], x[:, c])).all() for c in range(4))
    sizes = np.array([len(c) + 1 for c in cuts])
    starts = np.cumsum(sizes) - sizes
    none = histogram_trees.Trees(np.full((1, 7), -1), np.zeros((1, 7)), np.zeros((1, 7)))
    found, = histogram_trees.level_sums("squared", 0, 1.0, none, none, [0], starts, int(sizes.sum()), [1, 2], [(bins, y, keys, f)])
    rows = found[:-2].reshape(3, -1)[2]
    assert [int(rows[a:a + n].sum()) for a, n in zip(starts, sizes)] == [0, 900, 900, 0]


def test_columns_of_few_bins_are_counted_together():
    """Every column was counted on its own, three times over the rows."""
    rng = np.random.default_rng(3)
    sizes = np.array([5, 2, 120, 2, 3])
    starts, x = np.cumsum(sizes) - sizes, np.asfortranarray((rng.random((700, 5)) * sizes).astype(np.uint8))
    groups = histogram_trees.joint_columns([0, 1, 3, 4], sizes, 64)
    assert sorted(c for g in groups for c in g) == [0, 1, 3, 4] and len(groups) == 1
    tree = histogram_trees.Trees(np.array([[2, -1, 0, -1, -1, -1, -1]]), np.array([[60, 0, 1, 0, 0, 0, 0]]), np.zeros((1, 7)))
    none = histogram_trees.Trees(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 7)))
    y, keys, f = rng.gamma(1, 1, 700), rng.integers(0, 1 << 62, 700).astype(np.uint64), rng.normal(size=700)
    leaf = np.where(x[:, 2] <= 60, 1, np.where(x[:, 0] <= 1, 5, 6))
    assert (tree.leaves(x, 0) == leaf).all()
    for loss in ("tweedie", "squared"):
        found, = histogram_trees.level_sums(loss, 4, 0.7, none, tree, [1, 6], starts, int(sizes.sum()), [0, 1, 2, 4], [(x[:400], y[:400], keys[:400], f[:400]), (x[400:], y[400:], keys[400:], f[400:])])
        found, taken = found[:-2].reshape(3, 2, -1), picked(keys, 4, 0.7)
        for n, node in enumerate((1, 6)):
            rows = taken & (leaf == node)
            for part, w in zip(found, (*derivatives(loss, y, f), np.ones(700))):
                for c in (0, 1, 2, 4):
                    assert part[n, starts[c]:starts[c] + sizes[c]] == pytest.approx(np.bincount(x[rows, c], w[rows], sizes[c]))
        assert not found[:, :, starts[3]:starts[4]].any()


def test_blocks_are_dealt_out_evenly(spark):
    """Tasks held as many blocks as their files, and every job waited for the largest."""
    lying = spark.sparkContext.parallelize(range(41), 3).mapPartitionsWithIndex(lambda p, rows: rows if p else [*rows][:2])
    dealt = [histogram_trees.dealt(lying, 4).glom().collect() for _ in range(2)]
    assert sorted(b for part in dealt[0] for b in part) == sorted(lying.collect()) and dealt[0] == dealt[1]
    assert max(map(len, dealt[0])) - min(map(len, dealt[0])) <= 3


def test_edges_of_bins_are_exact_ranks(spark, monkeypatch):
    """Small summaries hold every value; larger ones are off by little."""
    rng = np.random.default_rng(8)
    x = np.c_[rng.gamma(1, 100, 6000), np.where(rng.random(6000) < 0.9, 0.0, rng.random(6000)), np.full(6000, 2.0)]
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    monkeypatch.setattr(histogram_trees, "FEW_ROWS", 0)
    model = HistogramTrees("squared", 1, bins=64)
    for f, cuts in enumerate(model._cuts(rows, 3)):
        assert (cuts == np.unique(np.sort(x[:, f])[np.maximum(1, -(-np.arange(65) * 6000 // 64)) - 1])[:-1]).all()
    summary = histogram_trees.condensed(*histogram_trees.merged([(np.sort(x[:, 0]), np.ones(6000, int))]), 500)
    assert len(summary[0]) <= 501 and summary[1].sum() == 6000 and summary[0][0] == x[:, 0].min() and summary[0][-1] == x[:, 0].max()
    ranks = np.searchsorted(np.sort(x[:, 0]), summary[0], side="right")
    assert (ranks == np.cumsum(summary[1])).all()


def test_a_hurdle_fits_its_design_once_and_its_parts_side_by_side(table, monkeypatch):
    """The second model of a hurdle fitted the same design again, after the first had ended."""
    from ledgerloom.operators import boosting
    from ledgerloom.operators.design import Design
    fits, running = [], []
    fit, trees = Design.fit, HistogramTrees.fit
    monkeypatch.setattr(Design, "fit", lambda self, rows: fits.append(1) or fit(self, rows))

    def started(self, *args):
        running.append(self.loss)
        out = trees(self, *args)
        running.append("end")
        return out

    monkeypatch.setattr(HistogramTrees, "fit", started)
    rows = table.selectExpr("customer_id", "cutoff", "x[0] AS a", "x[1] AS b", "if(y > 1, y, 0) AS future_revenue_gbp")
    model = boosting.BoostedHurdle(Design(numeric=("a", "b"), country=False), trees=3, depth=2).fit(rows)
    assert len(fits) == 1 and sorted(running[:2]) == ["gamma", "logistic"]
    alone = boosting.LogLinkBoosting(Design(numeric=("a", "b"), country=False), "gamma", 3, 2, 0.045, 10.0, 40, row_share=1.0).fit(rows)
    assert (alone.trees.feature == model.amount.trees.feature).all() and np.allclose(alone.trees.value, model.amount.trees.value)


@pytest.mark.parametrize("loss,label", [("tweedie", "y"), ("absolute", "y")])
def test_many_rows_are_fitted_as_few_are(table, monkeypatch, loss, label):
    """Dealt blocks, columns counted together and edges by ranks give the same trees."""
    def fit():
        return HistogramTrees(loss, 4, 3, 0.2, 5.0, 15, row_share=0.8, store_every=2).fit(table, label, F.col("customer_id"))

    few = fit()
    monkeypatch.setattr(histogram_trees, "FEW_ROWS", 0)
    monkeypatch.setattr(histogram_trees, "SMALL_BLOCK", 100)
    monkeypatch.setattr(histogram_trees, "SMALL_TASK", 500)
    many = fit()
    assert (few.feature == many.feature).all() and (few.threshold == many.threshold).all() and np.allclose(few.value, many.value)
