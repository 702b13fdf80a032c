"""Design-based variance and quantiles against explicit zero-padded arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_quantiles, running_totals
from cohortlens.operators import survey as V


def padded(df: pd.DataFrame, domain, stat):
    """Estimate and error with a score of zero for every cluster without a domain row."""
    inside = domain & df.y.notna()
    w, y = df.w.where(inside, 0.0), df.y.where(inside, 0.0)
    total, size = (w * y).sum(), w.sum()
    u = w * y if stat == "total" else w * (y - total / size) / size
    z = u.groupby([df.h, df.i]).sum()
    var, grand = 0.0, z.mean()
    for _, g in z.groupby(level=0):
        n = len(g)
        var += ((g - grand) ** 2).sum() if n == 1 else n / (n - 1) * ((g - g.mean()) ** 2).sum()
    return (total if stat == "total" else total / size), np.sqrt(var)


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(3)
    n = 400
    h = rng.integers(0, 6, n)
    i = np.where(h == 5, 99, h * 10 + rng.integers(0, 4, n))  # stratum 5 has one cluster
    y = rng.integers(0, 2, n).astype(float)
    y[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"h": h, "i": i, "w": rng.random(n) + 0.1, "y": y, "g": i % 3})


@pytest.mark.parametrize("stat", ["mean", "total"])
def test_domains_and_single_cluster_strata(spark, people, stat):
    rows = people.astype(object).where(people.notna(), None)
    df = spark.createDataFrame(list(rows.itertuples(index=False, name=None)),
                               "h long, i long, w double, y double, g long")
    d = V.survey_design(df, "h", "i", "w")
    est = V.survey_mean if stat == "mean" else V.survey_total
    got = {r["g"]: r for r in est(d, ["y"], ["g"]).collect()}
    for g, r in got.items():
        value, se = padded(people, people.g == g, stat)
        assert r["estimate"] == pytest.approx(value, rel=1e-10)
        assert r["se"] == pytest.approx(se, rel=1e-8)


def test_single_cluster_rules_and_design_errors(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 1.0, 0), (2, 3, 1.0, 1)], "h int, i int, w double, y int")
    adjust = V.survey_mean(V.survey_design(df, "h", "i", "w"), ["y"]).first()["se"]
    remove = V.survey_mean(V.survey_design(df, "h", "i", "w", lonely="remove"), ["y"]).first()["se"]
    # scores are 1/9, -2/9, 1/9: the pair of stratum 1 adds 2 * (1.5/9)^2 * 2, the single one (1/9)^2
    assert remove**2 == pytest.approx(2 * (2 * (1.5 / 9) ** 2))
    assert adjust**2 == pytest.approx(remove**2 + 1 / 81)
    with pytest.raises(ValueError):
        V.survey_mean(V.survey_design(df, "h", "i", "w", lonely="fail"), ["y"])
    split = df.withColumn("i", F.lit(1))
    with pytest.raises(ValueError):
        V.survey_design(split, "h", "i", "w")
    assert V.design_summary(V.survey_design(split, "h", "i", "w", nest=True)).first()["n_psu"] == 2
    with pytest.raises(ValueError):
        V.survey_design(df.withColumn("w", F.when(F.col("i") > 1, F.col("w"))), "h", "i", "w")


def test_totals_of_domains_add_up_and_shares_sum_to_one(spark, people):
    full = people.dropna()
    df = spark.createDataFrame(full)
    d = V.survey_design(df, "h", "i", "w", rescale=True)
    parts = sum(r["estimate"] for r in V.survey_total(d, ["y"], ["g"]).collect())
    assert parts == pytest.approx(V.survey_total(d, ["y"]).first()["estimate"])
    assert sum(r["estimate"] for r in V.survey_levels(d, "g").collect()) == pytest.approx(1)
    assert sum(r["freq"] for r in V.survey_table(d, ["g"]).collect()) == pytest.approx(len(full))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame(
        [(k % 2, k, 1.0 + (k % 3), k % 7) for k in range(60)], "h int, i int, w double, x int"
    )
    d = V.survey_design(df, "h", "i", "w")
    got = {r["p"]: r for r in V.survey_quantiles(d, "x").collect()}
    w = {v: sum(1.0 + (k % 3) for k in range(60) if k % 7 == v) for v in range(7)}
    for p in (0.25, 0.5, 0.75):
        acc = 0.0
        for v in range(7):
            acc += w[v]
            if acc >= p * sum(w.values()):
                break
        assert got[p]["quantile"] == v
        assert got[p]["ci_low"] <= v <= got[p]["ci_high"]
    assert (got[0.0]["quantile"], got[1.0]["quantile"]) == (0, 6)


def test_exact_quantiles_narrow_large_groups(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.lognormal(size=60_000), 3)
    x[:20_000] = 1.5  # a third of all rows share one value
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(60_000) % 2, "x": x}))
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = exact_quantiles(df, "x", probs, ["g"], small=200).collect()
    for r in got:
        want = np.quantile(x[np.arange(60_000) % 2 == r["g"]], probs)
        assert r["q"] == pytest.approx(list(want), rel=1e-12)


def test_running_totals_keep_order_over_slices(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5000, 20_000)
    got = (
        running_totals(spark.createDataFrame(pd.DataFrame({"x": x})).repartition(8), "x", {"n": F.count(F.lit(1))})
        .orderBy("x").toPandas()
    )
    assert (got["n_before"].to_numpy() == np.concatenate([[0], np.cumsum(got["n"])[:-1]])).all()
    assert got["n"].sum() == len(x)
