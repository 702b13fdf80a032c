"""Quantiles by narrowing enclosures, plain and weighted, whatever the size at which the values are taken one by one."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import quantiles as Q
from cohortlens.operators import survey as V


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    n = 4000
    x = np.concatenate([
        rng.normal(size=n), rng.lognormal(sigma=8, size=n), -rng.lognormal(sigma=8, size=n), np.zeros(n), np.full(n, 7.25),
        [1e-320, -1e-320, 1e300, -1e300, 2.0, math.nextafter(2.0, 3), -0.0],
    ])
    g = rng.choice(["a", "b", None], len(x), p=[0.7, 0.2, 0.1])
    return pd.DataFrame({"g": g, "x": x})


@pytest.mark.parametrize("small", [1, 50, 20_000])
def test_quantiles_of_groups(spark, values, small):
    df = spark.createDataFrame(list(values.itertuples(index=False)), "g string, x double").repartition(6)
    df = df.union(spark.createDataFrame([("empty", None), ("a", None)], "g string, x double"))
    probs = [0, 0.001, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r for r in Q.exact_quantiles(df, "x", probs, ["g"], small=small).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        x = values.x[values.g == g] if g else values.x[values.g.isna()]
        assert r["n"] == len(x)
        assert r["q"] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    also = {r["g"]: r for r in Q.exact_quantiles(df, "x", [0.5], ["g"], {"top": F.max("_x")}, small).collect()}
    assert also["empty"]["n"] == 0 and also["empty"]["q"] is None and also["a"]["top"] == values.x[values.g == "a"].max()


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert Q.exact_quantiles(df, "x", [0.5], ["g"]).count() == 0


@pytest.mark.parametrize("small", [1, 40])
def test_weighted_selection(spark, values, small):
    rng = np.random.default_rng(9)
    m = rng.integers(1, 50, len(values)).astype(float)
    rows = values.assign(m=m)
    df = spark.createDataFrame(list(rows[["x", "m"]].itertuples(index=False)), "_x double, _m double").selectExpr("0 AS w", "*")
    goals = [float(x) for x in (1, m.sum() / 3, m.sum() / 2, m.sum(), m.sum() * 2)]
    targets = spark.createDataFrame(list(enumerate(goals)), "_t int, _goal double").selectExpr("0 AS w", "*")
    spans = df.groupBy("w").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_size"))
    got = {r["_t"]: r["_v"] for r in Q.select_values(Q.stage(df), targets, ["w"], spans, small).collect()}
    order = np.argsort(values.x.to_numpy(), kind="stable")
    cum = np.cumsum(m[order])
    for t, goal in enumerate(goals):
        assert got[t] == values.x.to_numpy()[order][min(np.searchsorted(cum, goal), len(cum) - 1)]


def test_rescaled_and_missing_weights(spark):
    rng = np.random.default_rng(10)
    rows = [(i % 4, i % 40, float(rng.integers(1, 9)), float(rng.integers(0, 30)) if i % 7 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "h int, c int, w double, x double")
    out = V.survey_quantiles(V.survey_design(df, "h", "c", "w", rescale=True), "x", [0.25, 0.5]).collect()
    frame = pd.DataFrame(rows, columns=["h", "c", "w", "x"])
    frame["f"] = frame.w * frame.groupby("c").w.transform("size") / frame.groupby("c").w.transform("sum")
    used = frame.dropna().sort_values("x")
    cum = used.f.cumsum().to_numpy()
    for r in out:
        assert r["quantile"] == used.x.to_numpy()[np.searchsorted(cum, r["p"] * cum[-1] * (1 - 1e-12))]
        assert r["ci_low"] <= r["quantile"] <= r["ci_high"] and r["se"] > 0
    with pytest.raises(ValueError, match="no row"):
        V.survey_quantiles(V.survey_design(df.withColumn("x", F.lit(None).cast("double")), "h", "c", "w"), "x")
