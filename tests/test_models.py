"""Models on simulated rows: agreement with other solvers, recovery, limits."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.functions import tails
from cohortlens.operators import catalytic as C
from cohortlens.operators import diagnostics as D
from cohortlens.operators import logistic as M
from cohortlens.operators import mixed as X
from cohortlens.operators import mixture as N
from cohortlens.operators import smooth as S
from cohortlens.operators import spatial as A


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_sf(2.2281388519649385, 10) == pytest.approx(0.025, rel=1e-9)
    assert tails.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_ppf(0.975, 5) == pytest.approx(2.5705818366147395, rel=1e-9)
    assert tails.norm_ppf(0.975) == pytest.approx(tails.Z95, rel=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, k = rng.normal(size=n).round(2), rng.integers(1, 4, n)
    p = 1 / (1 + np.exp(-(-0.5 + 0.8 * x + 0.4 * (k == 2) - 0.6 * (k == 3))))
    return pd.DataFrame({"x": x, "k": k, "y": (rng.random(n) < p).astype(int)})


def _newton(x, y, firth=False):
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = mu * (1 - mu)
        info = (x * w[:, None]).T @ x
        r = y - mu
        if firth:
            r = r + w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(info), x) * (0.5 - mu)
        beta = beta + np.linalg.solve(info, x.T @ r)
    return beta


@pytest.mark.parametrize("kind", ["ml", "firth"])
def test_logistic_equals_dense_newton(spark, rows, kind):
    df = spark.createDataFrame(rows)
    m = M.fit_logistic(df, "y", ["x", M.factor("k")], kind)
    x = np.column_stack([np.ones(len(rows)), rows.x, rows.k == 2, rows.k == 3]).astype(float)
    assert m.converged
    assert m.beta == pytest.approx(_newton(x, rows.y.to_numpy(), kind == "firth"), abs=1e-7)


def test_firth_is_finite_under_separation(spark):
    df = spark.createDataFrame([(1, i % 2) for i in range(40)] + [(2, 0)] * 10, "k int, y int")
    firth = M.fit_logistic(df, "y", [M.factor("k")], "firth")
    assert firth.converged and abs(firth.beta[1]) < 5
    ml = M.fit_logistic(df, "y", [M.factor("k")])
    flagged = {r["term"]: r["separated"] for r in M.fit_separation(df, ml).collect()}
    assert flagged["k[2]"] and not flagged["(Intercept)"]
    levels = {r["level"]: r["separated"] for r in M.level_separation(df, "y", ["k"]).collect()}
    assert levels == {"1": False, "2": True}


def test_sweep_members_equal_single_fits(spark, rows):
    df = spark.createDataFrame(rows)
    sweep = {m.model_id: m for m in M.model_sweep(df, ["y"], ["x", M.factor("k")])}
    assert set(sweep) == {"y~x", "y~k", "y~adjusted"}
    alone = M.fit_logistic(df, "y", ["x"], "firth")
    assert sweep["y~x"].beta == pytest.approx(alone.beta, abs=1e-8)
    table = M.odds_ratios(df, list(sweep.values())).toPandas()
    assert np.allclose(np.exp(table.estimate), table.odds_ratio)


def test_diagnostics(spark, rows):
    df = spark.createDataFrame(rows.assign(id=range(len(rows))))
    m = M.fit_logistic(df, "y", ["x", M.factor("k")])
    scored = M.score(df, m)
    got = scored.toPandas()
    assert got.hat.sum() == pytest.approx(4, rel=1e-6)
    assert (got.deviance**2).sum() == pytest.approx(-2 * m.loglik, rel=1e-8)
    vif = {r["term"]: r["vif"] for r in D.collinearity(df, m).collect()}
    assert 1 <= vif["x"] < 1.1
    curve = D.curvature_tests(df, m).first()
    assert curve["term"] == "x" and 0 <= curve["p"] <= 1
    out = D.outlier_test(scored, "id").first()
    assert out["p_bonferroni"] <= 1 and abs(out["rstudent"]) >= got.deviance.abs().max() - 1e-9


def _laplace(par, x, y, cluster, house, nested):
    beta, sb, sc = par[:2], par[2], par[3] if nested else 0.0
    total = 0.0
    for c in np.unique(cluster):
        i = cluster == c
        design = np.column_stack([np.full(i.sum(), sb)] + [sc * (house[i] == h) for h in np.unique(house)])
        z = np.zeros(design.shape[1])
        for _ in range(40):
            mu = 1 / (1 + np.exp(-(beta[0] + beta[1] * x[i] + design @ z)))
            hess = design.T @ (design * (mu * (1 - mu))[:, None]) + np.eye(len(z))
            z = z + np.linalg.solve(hess, design.T @ (y[i] - mu) - z)
        eta = beta[0] + beta[1] * x[i] + design @ z
        total += np.sum(y[i] * eta - np.logaddexp(0, eta)) - z @ z / 2 - np.linalg.slogdet(hess)[1] / 2
    return total


@pytest.mark.parametrize("nested", [False, True])
def test_mixed_model_is_the_laplace_optimum(spark, nested):
    rng = np.random.default_rng(2)
    cluster, house = np.repeat(np.arange(50), 12), np.tile(np.repeat(np.arange(3), 4), 50)
    x = rng.normal(size=600).round(1)
    effect = rng.normal(size=50)[cluster] + 0.7 * rng.normal(size=(50, 3))[cluster, house]
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + 0.6 * x + effect)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"c": cluster, "h": house, "x": x, "y": y}))
    m = X.fit_mixed(df, "y", ["x"], "c", "h" if nested else None)
    par = np.array([*m.fixed.beta, *(m.sd if nested else m.sd[:1])])
    best = _laplace(par, x, y, cluster, house, nested)
    assert m.converged and m.loglik == pytest.approx(best, abs=1e-2)
    for k in range(len(par)):
        for step in (-0.03, 0.03):
            moved = par.copy()
            moved[k] += step
            assert _laplace(moved, x, y, cluster, house, nested) < best
    assert X.mixed_odds_ratios(df, [m]).count() == 3 + nested


def test_mixture_recovers_components(spark):
    rng = np.random.default_rng(4)
    z = np.where(rng.random(6000) < 0.3, rng.normal(5, 0.5, 6000), rng.normal(2, 0.8, 6000))
    df = spark.createDataFrame(pd.DataFrame({"s": np.exp(z)}))
    fit = N.fit_mixtures(df, {"s": 2})[0]
    assert fit.converged
    assert fit.weight == pytest.approx([0.7, 0.3], abs=0.03)
    assert fit.mean == pytest.approx([2, 5], abs=0.1)
    dens = N.mixture_density(df, [fit]).toPandas()
    assert len(dens) == 100 and dens.n.sum() == 6000


def test_posterior_draws_and_density(spark):
    counts = spark.createDataFrame(
        [("a", "overall", "all", a, 200, int(200 * 0.6 * (1 - np.exp(-0.2 * a)))) for a in range(1, 15)],
        "antigen string, stratifier string, level string, age int, n long, k long",
    )
    m = C.posterior_marginals(counts, 100).toPandas()
    assert m.groupby("parameter").mass.sum().tolist() == pytest.approx([1, 1])
    s = {r["parameter"]: r for r in C.posterior_summary(C.posterior_marginals(counts, 100)).collect()}
    assert s["lambda"]["low"] < 0.12 < s["lambda"]["high"]
    draws = C.posterior_draws(counts, 1000, 100).toPandas()
    assert sorted(draws.draw) == list(range(1000))
    assert np.median(draws["lambda"]) == pytest.approx(s["lambda"]["median"], rel=0.02)
    assert np.quantile(draws.rho, 0.975) == pytest.approx(s["rho"]["high"], rel=0.1)


def test_kernel_density_is_the_kernel_sum(spark):
    x = np.random.default_rng(6).normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    got = C.kernel_density(df, "x", ["g"]).toPandas().sort_values("x")
    bw = 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * 400**-0.2
    want = np.exp(-((got.x.to_numpy()[:, None] - x) ** 2) / (2 * bw * bw)).sum(1) / (400 * bw * np.sqrt(2 * np.pi))
    assert np.abs(got.density - want).max() < 1e-4
    assert len(got) == 512


def test_eb_on_a_grid_and_isolated_area(spark):
    squares = [(10 * i + j, p, 0, s, float(i + dx), float(j + dy)) for p in (0,) for i in range(3)
               for j in range(3) for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    far = [(99, 0, 0, s, 50.0 + dx, 50.0 + dy) for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])]
    v = spark.createDataFrame(squares + far, "area_id int, part int, ring int, seq int, x double, y double")
    edges = A.queen_neighbours(v)
    pairs = {tuple(r) for r in edges.collect()}
    assert len(pairs) == 40 and all((b, a) in pairs for a, b in pairs)
    facts = A.neighbour_summary(v, edges).first()
    assert (facts["regions"], facts["links"], facts["isolated"]) == (10, 40, 1)
    data = {10 * i + j: (10 + i + j, 2 + (i * j) % 3) for i in range(3) for j in range(3)} | {99: (8, 4)}
    areas = spark.createDataFrame([(k, n, r) for k, (n, r) in data.items()], "area_id int, n int, r int")
    got = {r["area_id"]: r["est"] for r in A.eb_local(areas, edges, ["r"]).collect()}
    hood = {k: [k] + [b for a, b in pairs if a == k] for k in data}
    rate = {k: sum(data[j][1] for j in h) / sum(data[j][0] for j in h) for k, h in hood.items()}
    for k, h in hood.items():
        size = sum(data[j][0] for j in h)
        c = sum(data[j][0] * (data[j][1] / data[j][0] - rate[j]) ** 2 for j in h)
        a = max(0.0, c / size - rate[k] / (size / len(h)))
        n, r = data[k]
        want = rate[k] + (r / n - rate[k]) * a / (a + rate[k] / n)
        assert got[k] == pytest.approx(want)


def test_loess_is_the_weighted_quadratic_fit(spark):
    x = np.arange(15.0)
    y = np.sin(x / 4) + 0.05 * np.cos(7 * x)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": y}))
    from pyspark.sql import functions as F

    got = S.loess(df, "x", "y", ["g"], F.array(F.lit(0.5), F.lit(7.0), F.lit(20.0))).toPandas().set_index("x")

    def operator(x0):
        d = np.abs(x - x0)
        w = np.clip(1 - (d / np.sort(d)[6]) ** 3, 0, None) ** 3
        z = np.column_stack([np.ones(15), x - x0, (x - x0) ** 2])
        return np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T)[0]

    full = np.vstack([operator(v) for v in x])
    rest = np.eye(15) - full
    sigma = np.sqrt(((y - full @ y) ** 2).sum() / np.trace(rest @ rest.T))
    for x0 in (0.5, 7.0):
        assert got.fit[x0] == pytest.approx(operator(x0) @ y, abs=1e-10)
        assert got.se[x0] == pytest.approx(sigma * np.sqrt((operator(x0) ** 2).sum()), abs=1e-10)
    assert np.isnan(got.fit[20.0])


def test_histogram_steps():
    assert [S.pretty_step(0, v, 10) for v in (10, 23, 38, 80, 100)] == [1, 2, 5, 10, 10]
