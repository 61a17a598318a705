from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerloom.operators import boosting, models, segments
from ledgerloom.operators.design import Design, additive_design, plain_design, spline_design
from ledgerloom.operators.segments import SegmentSpace
from ledgerloom.sources import store

DAY = date(2011, 6, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 600
    a, b = rng.gamma(2, 10, n), rng.normal(5, 2, n)
    y = rng.random(n) < 1 / (1 + np.exp(-(a / 10 - 2)))
    pdf = pd.DataFrame(dict(customer_id=np.arange(n), cutoff=DAY, a=a, b=b, country=rng.choice(["x", "y", "it's"], n, p=[0.5, 0.47, 0.03]),
                            inactive=y.astype(int), future_revenue_gbp=np.where(y, 0, np.exp(b / 4) * rng.gamma(2, 50, n)),
                            future_invoice_count=np.where(y, 0, 1 + rng.poisson(1, n))))
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b"))).persist()


def matrix(design, rows):
    fitted = design.fit(rows)
    return fitted, np.array([r[0] for r in fitted.transform(rows).orderBy("customer_id").select(vector_to_array("features")).collect()])


def test_plain_design(rows, spark):
    fitted, z = matrix(plain_design(["a", "b"]), rows)
    assert fitted.names == ["a", "b", "b__missing", "country__it's", "country__x", "country__y"]
    assert z[:, :3].mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9) and z[:, :3].std(axis=0) == pytest.approx(np.ones(3))
    unseen = fitted.transform(rows.limit(1).withColumn("country", F.lit("new"))).select(vector_to_array("features")).first()[0]
    assert unseen[3:] == [0, 0, 0]


def test_splines_sum_to_one_and_extrapolate(rows, spark):
    fitted = Design(splines=("a",), country=False, indicators="none", scale="none").fit(rows)
    low, high = fitted.ranges["a"]
    grid = spark.createDataFrame([(float(x),) for x in np.linspace(low, high, 50)] + [(low - 9,), (high + 9,)], "a double")
    z = np.array([r[0] for r in fitted.transform(grid).select(vector_to_array("features")).collect()])
    from ledgerloom.operators.design import spline_basis
    assert z.shape[1] == 6 and (z[:50] >= -1e-12).all()
    last = 1 - z[:50].sum(axis=1)  # the left-out function
    assert (last > -1e-9).all() and last[0] == pytest.approx(0) and last[49] == pytest.approx(1 / 6)
    assert z[50] == pytest.approx(z[0]) and z[51] == pytest.approx(z[49])
    linear = Design(splines=("a",), country=False, indicators="none", scale="none", extrapolation="linear").fit(rows)
    step = (high - low) / 4
    probe = spark.createDataFrame([(low,), (low - step,), (low - 2 * step,), (high,), (high + step,), (high + 2 * step,)], "a double")
    z = np.array([r[0] for r in linear.transform(probe).select(vector_to_array("features")).collect()])
    assert z[2] - z[1] == pytest.approx(z[1] - z[0]) and z[5] - z[4] == pytest.approx(z[4] - z[3])
    assert z[1] - z[0] == pytest.approx([0.5, 0, -0.5, 0, 0, 0])


def test_rare_countries_are_pooled(rows):
    fitted = additive_design(["a"], [], pool_below=60).fit(rows)
    assert [n for n in fitted.names if n.startswith("country")] == ["country__x", "country__y", "country__rare"]


def test_logistic_penalty_matches_newton(rows):
    design = plain_design(["a", "b"], country=False)
    _, z = matrix(design, rows)
    y = np.array([r[0] for r in rows.orderBy("customer_id").select("inactive").collect()], dtype=float)
    x = np.column_stack([z, np.ones(len(z))])
    w, penalty = np.zeros(x.shape[1]), np.diag([1.0] * z.shape[1] + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(0.25 * (x.T * (p * (1 - p))) @ x + penalty, 0.25 * x.T @ (p - y) + penalty @ w)
    model = models.LogisticModel(design, 0.25).fit(rows).model
    assert list(model.coefficients) + [model.intercept] == pytest.approx(list(w), abs=1e-4)


@pytest.mark.parametrize("kind,alpha", [("tweedie", 0.3), ("hurdle", 0.3), ("frequency_severity", 1.0)])
def test_revenue_glms(rows, kind, alpha):
    scored = models.RevenueGlm(plain_design(["a", "b"]), kind, alpha).fit(rows).predict(rows)
    totals = scored.agg(F.sum("predicted"), F.sum("future_revenue_gbp"), F.min("predicted"), F.corr("predicted", "future_revenue_gbp")).first()
    assert totals[0] == pytest.approx(totals[1], rel=0.25) and totals[2] >= 0 and totals[3] > 0.15


def test_calibration_and_prevalence(rows):
    scored = models.LogisticModel(spline_design(["a"]), 0.2).fit(rows).predict(rows)
    calibrated = models.Platt().fit(scored).predict(scored, output="q").agg(F.avg("q"), F.avg("inactive")).first()
    assert calibrated[0] == pytest.approx(calibrated[1], abs=0.01)
    assert models.Prevalence().fit(rows).probability == pytest.approx(rows.agg(F.avg("inactive")).first()[0])


def test_refits_see_only_finished_labels(spark):
    from ledgerloom.settings import add_months
    months = [date(2010, 6, 1), date(2010, 9, 1), date(2010, 12, 1), date(2011, 3, 1), date(2011, 6, 1)]
    panel = spark.createDataFrame([(i, c, add_months(c, 6), True, 100.0 * (i + 1)) for i, c in enumerate(months)],
                                  "customer_id bigint, cutoff date, horizon_end_exclusive date, label_mature boolean, future_revenue_gbp double")
    seen = []

    def spy(train, cohort):
        seen.append(sorted(r[0] for r in train.select("future_revenue_gbp").collect()))
        return cohort.withColumn("predicted", F.lit(1.0))

    def broken(train, cohort):
        raise RuntimeError("no fit")

    predictions, statuses = models.rolling_origins(panel, [date(2010, 12, 1), date(2011, 6, 1)], {"spy": spy, "broken": broken}, "6m")
    assert seen == [[100.0], [100.0, 200.0, 300.0]] and predictions.count() == 2
    assert sorted((r["model"], r["status"]) for r in statuses.collect()) == [("broken", "failed")] * 2 + [("spy", "completed")] * 2


def test_segment_scores(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3 + 1) % 3, float(i % 3) * 10 + (i % 7) / 7, float(i % 5)) for i in range(90)],
                               "customer_id bigint, s int, t int, x double, y double")
    assert segments.adjusted_rand(df, "s", "t").first()[0] == 1
    pdf = df.toPandas()
    centres = pdf.groupby("s")[["x", "y"]].mean()
    spread = pdf.groupby("s")[["x", "y"]].apply(lambda g: np.sqrt(((g - g.mean()) ** 2).sum(axis=1)).mean())
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centres.loc[i] - centres.loc[j]) for j in centres.index if j != i) for i in centres.index]
    assert segments.davies_bouldin(df, ["x", "y"], "s").first()[0] == pytest.approx(np.mean(worst))


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(8, 0.5, (200, 2))])
    df = spark.createDataFrame([(i, DAY, float(np.exp(a)), float(np.exp(b))) for i, (a, b) in enumerate(x)], "customer_id bigint, cutoff date, u double, v double")
    space = SegmentSpace(True).fit(df, ["u", "v"])
    points = space.transform(df).select("customer_id", "cutoff", "z")
    fits = segments.fit_mixtures(points, [2], starts=1, max_iter=40)
    assert sorted(fits[0].weights) == pytest.approx([0.4, 0.6], abs=0.02) and fits[0].converged
    assigned = fits[0].assign(points).groupBy("gmm_segment").count().collect()
    assert sorted(r["count"] for r in assigned) == pytest.approx([200, 300], abs=10)
    labelled = points.withColumn("segment", (F.col("customer_id") >= 300).cast("int"))
    assert segments.silhouette(labelled) > 0.9


@pytest.mark.parametrize("make,predict", [
    (lambda r: models.LogisticModel(plain_design(["a", "b"]), 0.25).fit(r), "p"),
    (lambda r: models.RevenueGlm(additive_design(["a"], []), "hurdle", 0.3).fit(r), "predicted"),
])
def test_saved_models_score_the_same(spark, rows, tmp_path, make, predict):
    from ledgerloom.operators import metrics
    from ledgerloom.sources.store import load_model, save_model
    model = make(rows)
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    audit = metrics.replay_difference(model.predict(rows), again.predict(rows), predict).first()
    assert audit["unmatched_keys"] == 0 and audit["max_absolute_difference"] == 0


def test_saved_parameters(spark, tmp_path):
    from ledgerloom.operators.behaviour import ParetoNbd
    from ledgerloom.sources.store import load_model, save_model
    save_model(spark, ParetoNbd(True, theta=np.array([1.0, 2.0])), str(tmp_path / "p"))
    again = load_model(spark, str(tmp_path / "p"))
    assert again.seasonal and list(again.theta) == [1.0, 2.0] and again.nodes == 24


def test_boosted_models_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, DAY, "x", float(a), float(b), float(max(0.0, 30 * a + rng.normal(0, 5) - 5))) for i, (a, b) in enumerate(rng.random((300, 2)))],
                                 "customer_id bigint, cutoff date, country string, a double, b double, future_revenue_gbp double")
    for k, model in enumerate((boosting.LogLinkBoosting(plain_design(["a", "b"]), "tweedie", rounds=3),
                               boosting.BoostedHurdle(plain_design(["a", "b"]), trees=2, depth=2))):
        fitted = model.fit(rows)
        store.save_model(spark, fitted, str(tmp_path / str(k)))
        again = store.load_model(spark, str(tmp_path / str(k)))
        want, got = ({r["customer_id"]: r["predicted"] for r in m.predict(rows).collect()} for m in (fitted, again))
        assert got == want and len(got) == 300


def test_a_killed_comparison_goes_on(spark, tmp_path):
    from ledgerloom.settings import add_months
    from ledgerloom.sources.runs import RunStore
    months = [date(2010, 6, 1), date(2010, 12, 1), date(2011, 6, 1)]
    panel = spark.createDataFrame([(i, c, add_months(c, 6), True, 100.0 * (i + 1)) for c in months for i in range(4)],
                                  "customer_id bigint, cutoff date, horizon_end_exclusive date, label_mature boolean, future_revenue_gbp double")
    fitted, broken = [], [True]

    def counting(train, cohort):
        fitted.append(cohort.first()["cutoff"])
        return cohort.withColumn("predicted", F.lit(-3.0 if len(fitted) > 1 else 7.0))

    def flaky(train, cohort):
        if broken[0]:
            raise RuntimeError("executor lost")
        return cohort.withColumn("predicted", F.lit(1.0))

    candidates = {"counting": counting, "flaky": flaky, "absent": None}
    runs = RunStore(str(tmp_path / "runs"), "s1")
    models.rolling_origins(panel, months[:2], candidates, "6m", runs, "refit_failed")
    broken[0] = False
    predictions, statuses = models.rolling_origins(panel, months, candidates, "6m", runs, "refit_failed")
    assert fitted == months[1:]  # the first origin has nothing to learn from; the second is not fitted again
    got = {(r["model"], r["cutoff"]): (r["status"], r["error"]) for r in statuses.collect()}
    assert {k: v[0] for k, v in got.items()} == {
        **{("absent", m): "unavailable" for m in months}, ("counting", months[0]): "unavailable", ("flaky", months[0]): "unavailable",
        **{(n, m): "completed" for n in ("counting", "flaky") for m in months[1:]}}
    rows = {(r["model"], r["cutoff"], r["customer_id"]): r["predicted"] for r in predictions.collect()}
    assert len(rows) == predictions.count() == 16 and rows["counting", months[1], 0] == 7.0 and rows["counting", months[2], 3] == 0.0
    # Two horizons in one store, united in one query: the later runs are there too.
    later = models.rolling_origins(panel, months, candidates, "90d", runs)
    assert statuses.unionByName(later[1]).groupBy("horizon").count().orderBy("horizon").collect() == [("6m", 9), ("90d", 9)]
    assert predictions.unionByName(later[0]).groupBy("horizon").count().orderBy("horizon").collect() == [("6m", 16), ("90d", 16)]
    with pytest.raises(ValueError, match="become folders"):
        runs.open_runs(spark, [("a/b", "6m", months[1])])
    again = RunStore(str(tmp_path / "runs"), "another source")
    assert len(again.open_runs(spark, [("counting", "6m", months[1])])) == 1 and not runs.open_runs(spark, [("counting", "6m", months[1])])
    runs.write(predictions.filter("model = 'flaky'").withColumn("predicted", F.lit(9.0)))
    replaced = runs.predictions(spark, [("flaky", "6m", months[1]), ("counting", "6m", months[1])])
    assert sorted((r["model"], r["predicted"]) for r in replaced.collect()) == [("counting", 7.0)] * 4 + [("flaky", 9.0)] * 4


def test_candidates_of_an_origin_are_fitted_side_by_side(spark):
    """A candidate waited for the one before, so a pair that meets could not end."""
    from threading import Barrier
    panel = spark.createDataFrame([(i, c, e, True, 100.0) for i, (c, e) in enumerate([(date(2010, 6, 1), date(2010, 12, 1)), (date(2011, 6, 1), date(2011, 12, 1))])],
                                  "customer_id bigint, cutoff date, horizon_end_exclusive date, label_mature boolean, future_revenue_gbp double")
    meeting = Barrier(2, timeout=60)

    def meets(train, cohort):
        meeting.wait()
        return cohort.withColumn("predicted", F.lit(1.0))

    _, statuses = models.rolling_origins(panel, [date(2011, 6, 1)], {"one": meets, "other": meets}, "6m")
    assert {r["model"]: r["status"] for r in statuses.collect()} == {"one": "completed", "other": "completed"}


def test_panels_of_two_horizons_are_built_together(spark, monkeypatch):
    """The features, which both share, were built once per horizon."""
    from ledgerloom.operators import panel as panels
    from ledgerloom.plans import inputs
    from ledgerloom.settings import NINETY_DAYS, SIX_MONTHS
    lines = [(c, f"{c}-{k}", f"{10000 + (c * k) % 7}", date(2000, 1, 1) + timedelta(days=17 * k + c), 1.0 + k, 2.0, f"N{c % 2}", 100 * c + k)
             for c in range(1, 9) for k in range(30 + c)]
    sold = spark.createDataFrame(lines, "customer_id long, invoice_id string, stock_code string, purchase_day date, quantity double, price double, country string, line_position long").selectExpr(
        "*", "CAST(purchase_day AS TIMESTAMP_NTZ) AS invoice_date", "CAST(quantity * price AS DECIMAL(18, 4)) AS revenue")
    credited = sold.filter("line_position % 5 = 0").selectExpr("customer_id", "invoice_id", "purchase_day AS credit_day", "revenue AS credit_amount_abs")
    built = []
    build = panels.build_panel
    monkeypatch.setattr(panels, "build_panel", lambda *a, **k: built.append(1) or build(*a, **k))
    both = inputs.labelled_snapshots(sold, credited, NINETY_DAYS, SIX_MONTHS)
    assert len(built) == 1
    for horizon in (NINETY_DAYS, SIX_MONTHS):
        alone = inputs.labelled_snapshots(sold, credited, horizon)
        mine = both.filter(F.col("horizon") == horizon.name).select(*alone.columns)
        rows = [sorted(map(str, x.collect())) for x in (alone, mine)]
        assert len(rows[0]) > 8 and rows[0] == rows[1]


def test_networks_of_an_ensemble_share_their_design_and_rows(spark, monkeypatch):
    """Every seed fitted the design and the scaling, and built the rows, again."""
    from ledgerloom.settings import WEEK_CHANNELS
    rng = np.random.default_rng(6)
    weeks = lambda r: [tuple(float(v) for v in w) for w in r]
    made = [(i, DAY, float(rng.normal()), "x", i % 2, weeks(rng.random((26, len(WEEK_CHANNELS))) + i % 2)) for i in range(60)]
    channels = ", ".join(f"{c}: float" for c in WEEK_CHANNELS)
    rows = spark.createDataFrame(made, f"customer_id long, cutoff date, a double, country string, inactive int, weeks array<struct<{channels}>>")
    make = lambda seed: models.WeeklyNetwork(plain_design(["a"]), hidden=3, iterations=5, seed=seed)
    alone = [make(seed).fit(rows).predict(rows, "p") for seed in (1, 2)]
    fits = []
    fit, scaling = Design.fit, models.sequence_scaling
    monkeypatch.setattr(Design, "fit", lambda self, train: fits.append("design") or fit(self, train))
    monkeypatch.setattr(models, "sequence_scaling", lambda *a: fits.append("scaling") or scaling(*a))
    found = models.seed_ensemble(make, [1, 2], rows, rows)
    assert sorted(fits) == ["design", "scaling"]
    read = lambda df: np.array([r["p"] for r in df.orderBy("customer_id").select("p").collect()])
    assert read(found) == pytest.approx((read(alone[0]) + read(alone[1])) / 2, abs=1e-9)
