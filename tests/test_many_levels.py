"""Factors with thousands of levels: shares, two-way tables and coefficients."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import logistic as M
from cohortlens.operators import survey as V
from cohortlens.operators import tables as T


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    n = 9000
    return pd.DataFrame({
        "h": rng.integers(0, 6, n), "c": 0, "w": rng.random(n) + 0.5, "g": rng.integers(0, 3, n), "v": rng.integers(0, 2500, n),
    }).assign(c=lambda d: d.h * 100 + rng.integers(0, 8, n))


@pytest.mark.parametrize("lonely", ["adjust", "remove"])
def test_shares_of_many_levels_equal_single_means(spark, rows, lonely):
    rows = pd.concat([rows, pd.DataFrame({"h": 9, "c": 999, "w": 1.0, "g": 1, "v": [3, 3, 4]})])
    df = spark.createDataFrame(rows).withColumn("v", F.when(F.col("v") % 97 != 5, F.col("v")))
    design = V.survey_design(df, "h", "c", "w", lonely=lonely)
    got = {(r["g"], r["level"]): r for r in V.survey_levels(design, "v", by=["g"]).collect()}
    levels = df.select("v").dropna().distinct().count()
    assert levels > 2000 and len(got) == 3 * levels
    for v in (3, 4, 1700):
        share = {"x": F.when(F.col("v").isNotNull(), (F.col("v") == v).cast("int"))}
        for r in V.survey_mean(design, share, ["g"]).collect():
            other = got[r["g"], str(v)]
            for name in ("n", "estimate", "se", "ci_low", "ci_high"):
                assert other[name] == pytest.approx(r[name], rel=1e-9, abs=1e-12)
    named = V.survey_levels(design, "v", levels=[3, 100_000]).collect()
    assert {r["level"]: r["estimate"] > 0 for r in named} == {"3": True, "100000": False}


def test_two_way_table_of_many_levels(spark, rows):
    df = spark.createDataFrame(rows)
    table = T.cross_table(df, ["v", "g"])
    n = rows.v.nunique()
    assert table.count() == 3 * n
    assert table.agg(F.sum("n")).first()[0] == len(rows)
    with_null = T.cross_table(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["g", "h"], {"h": [0, 77]}, include_null=True)
    got = {(r["g"], r["h"]): r["n"] for r in with_null.collect()}
    assert set(got) == {(g, h) for g in (None, 1, 2) for h in (0, 77)}
    assert got[None, 0] == int(((rows.g == 0) & (rows.h == 0)).sum()) and got[1, 77] == 0


def test_factor_beyond_a_hundred_levels(spark):
    rng = np.random.default_rng(13)
    k = np.repeat(np.arange(130), 20)
    y = (rng.random(len(k)) < 0.2 + 0.5 * (k % 3 == 0)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": k, "y": y}))
    m = M.fit_logistic(df, "y", [M.factor("k")], kind="firth")
    assert m.converged and len(m.beta) == 130
