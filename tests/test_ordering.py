import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import exact_quantiles, ranked, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; many equal values."""
    return spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, F.lit(None)).otherwise(F.col("id") % 5).cast("int").alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("v"))


def test_rank_in_hot_and_null_groups(skewed):
    pdf = ranked(skewed, [F.col("v").desc(), F.col("id").asc()], ["g"], "r", "n").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g", dropna=False).cumcount() + 1
    assert (pdf["r"] == want.reindex(pdf.index)).all()
    assert (pdf["n"] == pdf.groupby("g", dropna=False)["id"].transform("size")).all()


def test_running_totals(skewed):
    values = skewed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    pdf = running_totals(values, [F.col("v").desc()], {"cum": "c"}, ["g"]).toPandas()
    want = pdf.sort_values("v", ascending=False).groupby("g", dropna=False)["c"].cumsum()
    assert (pdf["cum"] == want.reindex(pdf.index)).all()
    assert (pdf["cum_total"] == pdf.groupby("g", dropna=False)["c"].transform("sum")).all()


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_exact_quantiles(skewed, groups):
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(skewed, ["v", "id"], probabilities, groups).toPandas()
    pdf = skewed.toPandas()
    pdf["g"] = pdf["g"].fillna(-1) if groups else 0
    if groups:
        found["g"] = found["g"].fillna(-1)
    else:
        found["g"] = 0
    assert len(found) == pdf["g"].nunique() * 2 * len(probabilities)
    for r in found.itertuples():
        values = pdf.loc[pdf["g"] == r.g, r.variable].to_numpy(dtype=float)
        assert r.quantile == pytest.approx(np.quantile(values, r.probability), abs=1e-9)


def test_small_groups_interpolate(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (3, 1.0), (3, 2.0), (3, 9.0), (4, None)], "g int, v double")
    rows = exact_quantiles(df, ["v"], [0.25, 0.5], ["g"]).collect()
    assert {(r["g"], r["probability"]): r["quantile"] for r in rows} == {
        (1, 0.25): 1.25, (1, 0.5): 1.5, (2, 0.25): 5.0, (2, 0.5): 5.0, (3, 0.25): 1.5, (3, 0.5): 2.0}


def test_medians_of_whole_tables_shuffle_few_values(spark):
    """All values of all columns were shuffled and laid out; now only those near the median are."""
    import random
    from statistics import median
    from ledgerloom.operators.ordering import exact_medians, values_near_medians
    draw = random.Random(5)
    rows = [(draw.gauss(0, 1), float(draw.randrange(3)), draw.random() if i % 3 else None, None, i, float("nan") if i % 4 else 1.0) for i in range(20_001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e bigint, f double").repartition(5)
    near = values_near_medians(df, ["a", "b", "c", "d", "e", "f"])
    assert near.count() < 2000
    assert sum(r["_c"] for r in near.filter("variable = 'a'").collect()) == 20_001
    found = exact_medians(df, ["a", "b", "c", "d", "e", "f"]).first()
    for k, name in enumerate("abc"):
        assert found[name] == median([r[k] for r in rows if r[k] is not None])
    assert found["d"] is None and found["e"] == 10_000.0 and found["f"] != found["f"]
    few = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    assert exact_medians(few, ["a"]).first()["a"] == 2.5 and exact_medians(few.limit(0), ["a"]).first()["a"] is None


def test_medians_of_few_values_are_not_laid_out(spark, monkeypatch):
    """Some hundred values near a median were sorted into files of ranges first, for every design of every fit."""
    from ledgerloom.operators import ordering
    df = spark.createDataFrame([(i % 7 + 0.5, None if i % 3 else float(i), float("nan") if i % 4 else 1.0) for i in range(1000)], "a double, b double, c double")
    monkeypatch.setattr(ordering, "FEW_VALUES", -1)
    want = ordering.exact_medians(df, ["a", "b", "c"]).first()
    monkeypatch.setattr(ordering, "FEW_VALUES", 1000)
    monkeypatch.setattr(ordering, "_lay_out", lambda *_: pytest.fail("values are laid out"))
    found = ordering.exact_medians(df, ["a", "b", "c"]).first()
    assert found[:2] == want[:2] == (3.5, 499.5) and found["c"] != found["c"] and want["c"] != want["c"]


def test_medians_take_no_approximate_percentile_and_no_row_per_value(spark, monkeypatch):
    """Bounds came from percentile_approx and every value was made a row before those near the median were kept."""
    import numpy as np
    from ledgerloom.operators import ordering
    rng = np.random.default_rng(2)
    x = np.round(rng.gamma(1, 50, (4001, 3)), 2)
    x[:, 1] = np.where(rng.random(4001) < 0.7, 0.0, x[:, 1])
    rows = [(*map(float, r[:2]), None if i % 3 else float(r[2]), float("nan") if i % 5 else -1.0, None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    for name in ("percentile_approx", "explode"):
        monkeypatch.setattr(ordering.F, name, lambda *_, name=name: pytest.fail(name))
    monkeypatch.setattr(ordering, "CUT_POINTS", 300)
    near, most = ordering._near_medians(df, ["a", "b", "c", "d", "e"])
    assert most > 0 and near.count() < 5000
    monkeypatch.undo()
    found = ordering.exact_medians(df, ["a", "b", "c", "d", "e"]).first()
    kept = [r[2] for r in rows if r[2] is not None]
    assert (found["a"], found["b"], found["c"]) == pytest.approx((np.median(x[:, 0]), np.median(x[:, 1]), np.median(kept)))
    assert np.isnan(found["d"]) and found["e"] is None
