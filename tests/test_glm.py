"""Penalised linear models against score equations, plain descent and one another."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerloom.operators import glm
from ledgerloom.operators.glm import Problem, fit_glms, unit_terms

FAMILIES = {"logistic": "any", "poisson": "counts", "gamma": "positive", "tweedie": "amount"}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = 0.0  # a column without information
    eta = 0.5 + x @ np.array([0.8, -0.4, 0.0, 0.0])
    counts = rng.poisson(np.exp(eta))
    positive = rng.gamma(2, np.exp(eta) / 2)
    return x, {"any": (eta + rng.logistic(size=1500) > 0).astype(float), "counts": counts.astype(float), "positive": positive,
               "amount": np.where(counts > 0, positive * 40, 0.0), "w": rng.integers(1, 5, 1500).astype(float)}


@pytest.fixture(scope="module")
def table(spark, data):
    x, labels = data
    rows = [([float(v) for v in x[i]], *[float(labels[c][i]) for c in labels]) for i in range(len(x))]
    made = spark.createDataFrame(rows, "x array<double>, " + ", ".join(f"{c} double" for c in labels))
    return made.withColumn("features", array_to_vector("x")).repartition(5).persist()


def gradient(x, y, w, family, score, alpha):
    eta = score.intercept + x @ score.coefficients
    slope = unit_terms(family, y, eta)[1]
    return np.r_[(w * slope).sum() / w.sum(), x.T @ (w * slope) / w.sum() + alpha * score.coefficients]


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("weight", [None, "w"])
def test_score_equations_hold(table, data, family, weight):
    x, labels = data
    w = labels["w"] if weight else np.ones(len(x))
    score = fit_glms(table, [Problem(family, FAMILIES[family], alpha=0.05, weight=weight)])[0]
    assert np.abs(gradient(x, labels[FAMILIES[family]], w, family, score, 0.05)).max() < 1e-6
    assert score.coefficients[3] == pytest.approx(0, abs=1e-9) and score.iterations <= 12


@pytest.mark.parametrize("family", FAMILIES)
def test_terms_are_derivatives(family):
    y, eta, d = np.array([0.5, 1.0, 3.0]), np.array([-0.7, 0.2, 1.1]), 1e-5
    up, down = unit_terms(family, y, eta + d), unit_terms(family, y, eta - d)
    loss, slope, curve = unit_terms(family, y, eta)
    assert (up[0] - down[0]) / (2 * d) == pytest.approx(slope, rel=1e-6) and (up[1] - down[1]) / (2 * d) == pytest.approx(curve, rel=1e-6)


def test_together_as_alone_and_in_small_blocks(table, monkeypatch):
    problems = [Problem("gamma", "some", 0.3), Problem("logistic", "any", strength=0.3), Problem("poisson", "counts", 0.1, weight="w")]
    rows = table.withColumn("some", F.when(F.col("any") == 1, F.col("positive")))
    together = fit_glms(rows, problems)
    monkeypatch.setattr(glm, "BLOCK_VALUES", 200)
    alone = [fit_glms(rows.filter("some IS NOT NULL") if p.label == "some" else rows, [p])[0] for p in problems]
    for a, b in zip(together, alone):
        assert a.coefficients == pytest.approx(b.coefficients, abs=1e-8) and a.intercept == pytest.approx(b.intercept, abs=1e-8)


def test_strength_is_the_inverse_penalty(table):
    by_strength, by_alpha = fit_glms(table, [Problem("logistic", "any", strength=0.2), Problem("logistic", "any", alpha=1 / (0.2 * 1500))])
    assert by_strength.coefficients == pytest.approx(by_alpha.coefficients, abs=1e-9)


def test_scores_in_the_plan(table, data):
    score = fit_glms(table, [Problem("tweedie", "amount", 0.01)])[0]
    found = table.select("x", score.margin().alias("m")).collect()
    assert [r["m"] for r in found] == pytest.approx([score.intercept + np.dot(r["x"], score.coefficients) for r in found])


def test_separable_and_empty_and_zero(table):
    score = fit_glms(table.withColumn("cut", (F.col("x")[0] > 0).cast("double")), [Problem("logistic", "cut", strength=50.0)])[0]
    assert score.coefficients[0] > 5
    for bad in (table.filter("w > 100"), table.withColumn("any", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="no training rows"):
            fit_glms(bad, [Problem("logistic", "any", 0.1)])
    with pytest.raises(ValueError, match="positive mean"):
        fit_glms(table.withColumn("none", F.lit(0.0)), [Problem("poisson", "none", 0.1)])


def test_blocks_of_a_task_are_not_held_together(spark):
    """Rows are blocks of megabytes; in one Arrow batch all blocks of a task were in memory at once."""
    size = 1 << 18  # numbers: 2 MB a block, 240 MB in one task
    blocks = spark.range(120, numPartitions=1).select(F.lit(size // 2).cast("long").alias("n"), F.expr(f"cast(repeat('a', {8 * size}) as binary)").alias("x"),
                                                      F.expr(f"cast(repeat('a', {4 * size}) as binary)").alias("rest"))

    def peak(matrix, columns):
        import resource
        return np.array([1.0, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])

    def worker(rows):
        import resource
        return [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]

    before = max(spark.sparkContext.parallelize([0], 1).mapPartitions(worker).collect())
    count, peaks = glm.summed(blocks, peak)
    assert count == 120 and peaks / 120 - before < 150_000  # kB


def test_stored_blocks_lie_in_small_row_groups(spark, monkeypatch):
    """A hundred blocks were held, and read again, as one row group."""
    import pyarrow.parquet as pq
    monkeypatch.setattr(glm, "BLOCK_VALUES", 1 << 18)  # two megabytes
    rows = spark.range(0, 40 * 2**14, 1, 1).select(array_to_vector(F.array(*[F.rand(i) for i in range(15)])).alias("features"), F.rand(99).alias("y"))
    blocks = glm.packed(rows, ["y"])
    (file,) = [f.removeprefix("file:").replace("///", "/") for f in blocks.inputFiles()]
    parts = [pq.ParquetFile(file).metadata.row_group(i) for i in range(pq.ParquetFile(file).metadata.num_row_groups)]
    assert sum(p.num_rows for p in parts) >= 40 and max(p.total_byte_size for p in parts) <= 20 << 20
    assert blocks.agg(F.sum("n")).first()[0] == 40 * 2**14
