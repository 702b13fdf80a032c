"""Mixtures and mixed models: optimum, shared passes, missing rows, large clusters, diagnostics by model."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import diagnostics as D
from cohortlens.operators import logistic as M
from cohortlens.operators import mixed as X
from cohortlens.operators import mixture as N


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    parts = [rng.normal(m, s, n) for m, s, n in ((1, 0.5, 900), (2.2, 0.4, 700), (4, 0.6, 1200))]
    three = rng.permutation(np.concatenate(parts))
    wide = rng.normal(0, 2, len(three))
    wide[::7] = np.nan
    return pd.DataFrame({"three": np.exp(three), "wide": np.exp(wide)})


def test_mixture_is_a_fixed_point_of_em(spark, signals):
    df = spark.createDataFrame(signals).selectExpr("three", "CASE WHEN isnan(wide) THEN NULL ELSE wide END AS wide")
    fits = N.fit_mixtures(df.repartition(5), {"three": 3, "wide": 2})
    for m in fits:
        assert m.converged and m.se is not None
        x = np.log(signals[m.signal].to_numpy())
        x = x[~np.isnan(x)]
        assert m.n == len(x)
        assert m.loglik == pytest.approx(N.pass_sums(x, m)[0], rel=1e-10)
        moved = m
        for _ in range(1000):
            moved = N.em_step(N.pass_sums(x, moved), moved)
        for name, error in zip(("weight", "mean", "variance"), m.se):
            assert np.all(np.abs(getattr(moved, name) - getattr(m, name)) < 0.01 * error)
    assert fits[0].mean == pytest.approx([1, 2.2, 4], abs=0.25)


def test_information_is_the_curvature_of_the_likelihood(signals):
    x = np.log(signals.three.to_numpy())
    m = N.Mixture("s", np.array([0.3, 0.3, 0.4]), np.array([0.8, 2.0, 3.9]), np.array([0.3, 0.2, 0.4]))
    gradient, information, _ = N._derivatives(N.pass_sums(x, m), m)
    loglik = lambda step: N.pass_sums(x, N._moved(m, step, 0.0))[0]
    e = np.eye(8) * 1e-4
    slope = [(loglik(a) - loglik(-a)) / 2e-4 for a in e]
    assert gradient == pytest.approx(slope, rel=1e-4, abs=1e-3)
    curve = [[(loglik(a + b) - loglik(a - b) - loglik(b - a) + loglik(-a - b)) / 4e-8 for b in e] for a in e]
    assert -np.array(curve) == pytest.approx(information, rel=1e-3, abs=1.0)


def test_mixture_of_a_constant_raises_and_a_short_run_says_so(spark, signals):
    with pytest.raises(ValueError, match="two different values"):
        N.fit_mixtures(spark.createDataFrame([(2.0,), (2.0,)], "s double"), {"s": 2})
    df = spark.createDataFrame(signals[["three"]])
    assert not N.fit_mixtures(df, {"three": 3}, max_passes=2)[0].converged


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(2)
    cluster, house = np.repeat(np.arange(40), 12), np.tile(np.repeat(np.arange(3), 4), 40)
    x, k = rng.normal(size=480).round(1), rng.integers(1, 4, 480)
    effect = rng.normal(size=40)[cluster] + 0.7 * rng.normal(size=(40, 3))[cluster, house]
    y = (rng.random(480) < 1 / (1 + np.exp(-(0.3 + 0.6 * x + 0.3 * k + effect)))).astype(int)
    rows = pd.DataFrame({"c": cluster, "h": house, "x": x, "k": k, "y": y}).astype({"x": object})
    rows.loc[::11, "x"] = None
    return rows


def _frame(spark, people):
    rows = [tuple(None if v is None else v.item() if hasattr(v, "item") else v for v in r) for r in people.itertuples(index=False)]
    return spark.createDataFrame(rows, "c int, h int, x double, k int, y int")


@pytest.mark.parametrize("household", [None, "h"])
def test_one_sweep_equals_single_fits_and_joins(spark, people, household):
    df = _frame(spark, people)
    models = [("a", "y", ["x"]), ("b", "y", [M.factor("k")]), ("c", "y", ["x", M.factor("k")])]
    together = X.fit_mixed_models(df, models, "c", household)
    for m, (key, y, terms) in zip(together, models):
        alone = X.fit_mixed(df, y, terms, "c", household)
        assert m.converged and alone.converged
        assert m.fixed.n == (people.x.notna().sum() if "x" in terms else len(people))
        assert m.n_clusters == 40
        assert m.loglik == pytest.approx(alone.loglik, abs=1e-6)
    wide = X.fit_mixed_models(df, models[2:], "c", household, largest_cluster=3)[0]
    assert wide.loglik == pytest.approx(together[2].loglik, abs=1e-3)
    assert wide.fixed.beta == pytest.approx(together[2].fixed.beta, abs=5e-3)
    assert wide.sd == pytest.approx(together[2].sd, abs=2e-2)


def test_no_variance_ends_at_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"c": np.repeat(np.arange(60), 2), "x": rng.normal(size=120).round(1), "y": np.tile([0, 1], 60)})
    m = X.fit_mixed(spark.createDataFrame(rows), "y", ["x"], "c")
    assert m.converged and m.sd[0] == pytest.approx(1e-3)


def test_diagnostics_by_model(spark, people):
    df = _frame(spark, people)
    models = X.fit_mixed_models(df, [("a", "y", ["x"]), ("b", "y", [M.factor("k")])], "c")
    rows = X.fitted_rows(models)
    size = D.parameters_of([m.fixed for m in models], {"a": 1, "b": 1})
    fit = {r["model_id"]: r for r in D.goodness_of_fit(rows, "y", "p_hat", size, by=["model_id"], n="n").collect()}
    binned = {r["model_id"]: r for r in D.share_inside(D.binned_residuals(rows, "y", "p_hat", by=["model_id"], n="n"), ["model_id"]).collect()}
    for m in models:
        one = rows.where(f"model_id = '{m.fixed.model_id}'").selectExpr("y", "p_hat", "explode(array_repeat(1, cast(n AS int))) AS one")
        plain = D.goodness_of_fit(one, "y", "p_hat", len(m.fixed.beta) + 1).first()
        got = fit[m.fixed.model_id]
        for name in ("n", "df", "deviance", "pearson", "p_deviance", "p_pearson"):
            assert got[name] == pytest.approx(plain[name], rel=1e-9)
        share = D.share_inside(D.binned_residuals(one, "y", "p_hat")).first()
        assert (binned[m.fixed.model_id]["bins"], binned[m.fixed.model_id]["inside"]) == tuple(share)
        # at the modes the cluster residuals are proportional to the effects, so they add up to the shrinkage
        assert plain["n"] == m.fixed.n
    vif = D.collinearity(df, *[m.fixed for m in models]).collect()
    assert {r["model_id"] for r in vif} == {"a", "b"} and all(r["vif"] == pytest.approx(1) for r in vif)


def test_penalised_patterns_score_like_rows(spark, people):
    df = _frame(spark, people)
    models = M.fit_models(df, [M.Model("f", "y", ["x", M.factor("k")], "firth"), M.Model("m", "y", [M.factor("k")])])
    rows = M.fitted_patterns(df, models)
    for m in models:
        scored = M.score(df, m).toPandas()
        got = rows.where(f"model_id = '{m.model_id}'").toPandas()
        assert got.n.sum() == len(scored)
        assert (got.n * got.p_hat).sum() == pytest.approx(scored.p_hat.sum())
        assert (got.n * got["hat"]).sum() == pytest.approx(scored["hat"].sum())
        assert scored["hat"].sum() == pytest.approx(len(m.beta), rel=1e-3)
