"""Blocks of mixed models: bounded row groups, equal clusters once, the same fits either way."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import running_totals
from cohortlens.operators import diagnostics as D
from cohortlens.operators import logistic as M
from cohortlens.operators import mixed as X
from cohortlens.operators import mixed_blocks as B


def _row_groups(blocks):
    for path in blocks.inputFiles():
        meta = pq.read_metadata(path.removeprefix("file:"))
        for i in range(meta.num_row_groups):
            yield meta.row_group(i)


def test_row_groups_hold_a_bounded_part_of_a_task(spark):
    rows = spark.range(400_000).select(
        (F.col("id") % 40_000).alias("_cluster"), F.lit(0).alias("_household"), F.lit(1).alias("_n"), (F.col("id") % 2).alias("y"),
        *[F.rand(i).alias(f"x{i}") for i in range(8)],
    )
    blocks = B.pack(rows.coalesce(1), [F.col("y")], [F.col(f"x{i}") for i in range(8)], block_rows=5_000)
    groups = list(_row_groups(blocks))
    assert sum(g.num_rows for g in groups) == blocks.count()
    # eight numbers of eight bytes a row; a group takes at most one block more than its limit
    assert max(g.total_byte_size for g in groups) < (8 << 20) + 5_000 * 100
    # what the planner splits by is what a task holds
    assert all(g.column(i).compression == "UNCOMPRESSED" for g in groups for i in range(g.num_columns))


@pytest.fixture(scope="module")
def few(spark):
    rng = np.random.default_rng(8)
    cluster = np.repeat(np.arange(900), 4)
    rows = pd.DataFrame({"c": cluster, "x": rng.integers(0, 2, 3600), "k": rng.integers(1, 4, 3600), "z": rng.normal(size=3600)})
    effect = rng.normal(size=900)[cluster]
    for name in ("y", "w"):
        rows[name] = (rng.random(3600) < 1 / (1 + np.exp(-(effect + 0.5 * rows.x - 0.3)))).astype(int)
    df = spark.createDataFrame(rows)
    return rows, df.withColumn("x", F.when(F.col("c") % 7 > 0, F.col("x"))).withColumn("y", F.when(F.col("z") < 1.5, F.col("y")))


MODELS = [("a", "y", ["x"]), ("b", "w", [M.factor("k")]), ("c", "w", ["x", "z"]), ("d", "w", ["x"])]


def test_equal_clusters_are_one_profile(spark, few):
    rows, df = few
    table = df.select(F.col("c").alias("_cluster"), F.lit(0).alias("_household"), F.lit(1).alias("_n"), "w", "x")
    found = B.profiles(table, [F.col("w")], [F.lit(1.0), F.col("x")], {0: (0, [0, 1])})
    blocks = [b for r in found.toArrow().to_batches() for b in B._blocks(r)]
    kept = df.where("x IS NOT NULL").select("c", "x", "w").toPandas()
    want = pd.Series([tuple(sorted(zip(g.x, g.w))) for _, g in kept.groupby("c")]).value_counts()
    got = {}
    for b in blocks:
        n, y, _, x = b.columns([0, 1, 2, 3])
        for i, times in enumerate(b.times):
            at = b.houses == i
            key = tuple(sorted(cell for *cell, k in zip(x[at], y[at], n[at].astype(int)) for cell in [tuple(cell)] * k))
            assert key not in got
            got[key] = int(times)
    assert got == want.to_dict() and len(got) < 60


def test_profiles_fit_like_whole_clusters(spark, few):
    _, df = few
    once = X.fit_mixed_models(df, MODELS, "c", few_values=100)
    whole = X.fit_mixed_models(df, MODELS, "c", few_values=0)
    for a, b in zip(once, whole):
        assert a.converged and a.n_clusters == b.n_clusters and a.fixed.n == b.fixed.n
        assert a.loglik == pytest.approx(b.loglik, rel=1e-10)
        assert a.fixed.beta == pytest.approx(b.fixed.beta, abs=1e-8) and a.sd == pytest.approx(b.sd, abs=1e-8)
    sums = lambda models: {
        r[0]: tuple(r)[1:] for r in X.fitted_rows(models).groupBy("model_id").agg(
            F.sum("n"), F.sum(F.col("n") * F.col("p_hat")), F.sum(F.col("n") * F.col("y") * F.log("p_hat"))).collect()
    }
    a, b = sums(once), sums(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-8) for k in a)
    assert X.fitted_rows(once).where("model_id = 'd'").count() < 0.2 * X.fitted_rows(whole).where("model_id = 'd'").count()


def test_equal_rows_of_equal_clusters_share_a_probability(spark, few):
    """Ties survive whatever else a block holds: the mode follows from a cluster's covariates and its number of events."""
    rows, df = few
    kept = df.where("x IS NOT NULL").select("c", "x", "w").toPandas()
    cells = {(x, tuple(sorted(g.x)), g.w.sum()) for _, g in kept.groupby("c") for x in set(g.x)}
    for few_values in (100, 0):
        models = X.fit_mixed_models(df.repartition(7), [("d", "w", ["x"]), ("c", "w", ["x", "z"])], "c", few_values=few_values)
        found = X.fitted_rows(models[:1]).where("model_id = 'd'").select("p_hat").distinct().toPandas().p_hat
        # equal clusters have equal digits; the same sums from other patterns may differ in the last one
        assert found.round(12).nunique() == len(cells) and len(found) <= len({(x, tuple(sorted(zip(g.x, g.w)))) for _, g in kept.groupby("c") for x in set(g.x)})
        # the mode of a cluster alone is that among others
        spec = B.Spec("d", 0, [0, 1], models[0].fixed.beta, models[0].sd)
        one = kept[kept.c == kept.c.iloc[0]]
        parts = [_open(one), _open(kept)]
        got = [B._solved(b, spec, 1).eta[: len(one)] for b in parts]
        assert (got[0] == got[1]).all()


def _open(kept):
    codes = pd.factorize(kept.c)[0]
    block = B._block(B.WIDE, np.arange(codes[-1] + 1), codes, np.ones(codes[-1] + 1), [np.ones(len(kept)), *kept[["w"]].to_numpy(float).T, np.ones(len(kept)), kept.x.to_numpy(float)])
    arrays = [np.frombuffer(block[k], t) for k, t in (("clusters", "<i4"), ("houses", "<i4"), ("times", "<i8"))]
    return B._Block(B.WIDE, *arrays, block["kinds"], memoryview(block["data"]))


def test_bins_store_counts_not_residuals(spark):
    """Bins from counts and outcomes equal those from residuals, and a pass over all values is not written out."""
    rng = np.random.default_rng(6)
    p = np.round(rng.random(4_000), 3).clip(0.001, 0.999)
    rows = pd.DataFrame({"y": (rng.random(4_000) < p).astype(float), "p": p, "n": rng.integers(1, 5, 4_000).astype(float)})
    got = D.binned_residuals(spark.createDataFrame(rows), "y", "p", n="n").orderBy("bin").toPandas()
    # whole rows by plain numpy, bins by the rank of the smallest row with the same probability
    whole = rows.loc[rows.index.repeat(rows.n.astype(int))].sort_values("p")
    total, k = len(whole), int(np.sqrt(len(whole)))
    before = np.searchsorted(whole.p.to_numpy(), whole.p.to_numpy(), side="left")
    whole["bin"] = np.minimum(k - 1, np.ceil((before + 1) * k / total).astype(int) - 1)
    want = whole.assign(r=whole.y - whole.p).groupby("bin").agg(n=("r", "size"), mean_p=("p", "mean"), mean_resid=("r", "mean"), sd=("r", "std"))
    assert got.bin.tolist() == want.index.tolist() and got.n.tolist() == want.n.tolist()
    for name in ("mean_p", "mean_resid"):
        assert got[name].to_numpy() == pytest.approx(want[name].to_numpy(), abs=1e-12)
    assert got.bound.to_numpy() == pytest.approx((2 * want.sd / np.sqrt(want.n)).to_numpy(), abs=1e-9)
    files = running_totals(
        spark.createDataFrame(rows), "p", {"n": F.sum("n")}
    ).select("p", "n", "n_before", "n_all")
    assert files.select("n_all").distinct().count() == 1 and files.first()["n_all"] == rows.n.sum()
