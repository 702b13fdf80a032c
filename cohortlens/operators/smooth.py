"""Data behind the plots: box statistics, histograms, local regression, age profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_quantiles
from cohortlens.functions.staging import attach, null_safe, stage
from cohortlens.operators.recode import floor_signal


def boxplot_stats(df: DataFrame, value: str, by: list[str], log10: bool = True) -> DataFrame:
    """Quartiles, whiskers and outlier count per group, taken after the log."""
    x = F.col(value).cast("double")
    y = F.log10(floor_signal(x)) if log10 else x
    rows = df.select(*by, y.alias("_y")).where(F.col("_y").isNotNull())
    q = exact_quantiles(rows, "_y", [0.25, 0.5, 0.75], by).select(
        *by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    boxed = attach(rows, q, by, "inner")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("_y").between(F.col("q1") - reach, F.col("q3") + reach)
    return boxed.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(near, F.col("_y"))).alias("whisker_low"),
        F.max(F.when(near, F.col("_y"))).alias("whisker_high"),
        F.count_if(~near).alias("outliers"),
    )


def pretty_step(lo: float, hi: float, n: int) -> float:
    """Step 1, 2 or 5 times a power of ten that cuts the range into about ``n`` cells."""
    cell = (hi - lo) / n if hi > lo else max(abs(hi), 1.0) / n
    base = 10.0 ** math.floor(math.log10(cell))
    step = base
    # each larger candidate wins when it is relatively closer to the wanted cell (bias 1.5, 2.75)
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell < bias * (cell - step):
            step = factor * base
    return step


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in round-number cells, closed on the right, the lowest value included."""
    x = F.col(value).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin_low double, bin_high double, n bigint")
    step = pretty_step(lo, hi, bins)
    start = math.floor(lo / step + 1e-7)
    cells = max(1, math.ceil(hi / step - 1e-7) - start)
    index = F.greatest(F.ceil(x / step - 1e-7), F.lit(start + 1)) - start - 1
    counted = df.where(x.isNotNull()).groupBy(index.cast("long").alias("i")).agg(
        F.count(F.lit(1)).alias("n")
    )
    filled = null_safe(df.sparkSession.range(cells).withColumnRenamed("id", "i"), counted, ["i"])
    return filled.select(
        ((F.col("i") + start) * F.lit(step)).alias("bin_low"),
        ((F.col("i") + start + 1) * F.lit(step)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points of two signals, complete pairs only."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()


def binned_scatter(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """Two-dimensional counts of the same points."""
    cell = [F.floor(F.col(c) / w).alias(f"{c}_bin") for c, w in (("x", width_x), ("y", width_y))]
    return scatter(df, x, y).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))


def prevalence_by_age(
    df: DataFrame, outcomes: list[str], strata: list[str], age: str = "age"
) -> DataFrame:
    """Share of positives per stratum and age (or age band), all outcomes in one pass."""
    sums = []
    for o in outcomes:
        sums += [F.count(o).alias(f"_n_{o}"), F.sum(F.col(o).cast("double")).alias(f"_k_{o}")]
    wide = df.where(F.col(age).isNotNull()).groupBy(*strata, age).agg(*sums)
    items = F.array(
        *[
            F.struct(F.lit(o).alias("outcome"), F.col(f"_n_{o}").alias("n"), F.col(f"_k_{o}").alias("k"))
            for o in outcomes
        ]
    )
    return wide.select(*strata, age, F.explode(items).alias("o")).select(
        *strata, age, "o.outcome", "o.n", F.try_divide("o.k", "o.n").alias("prevalence")
    )


def loess(
    df: DataFrame, x: str, y: str, by: list[str], at: Column, span: float = 0.5,
    max_points: int = 5000, with_se: bool = True,
) -> DataFrame:
    """Local quadratic regression, fitted directly at every point of ``at`` (an array column).

    Meant for a curve over a discrete axis such as age: values are first averaged per ``x``, and
    more than ``max_points`` distinct ``x`` in a group is an error.  Points outside the data range
    give null.  The standard error uses the exact trace of the residual operator.
    """
    by = list(by)
    curve = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(F.avg(F.col(y).cast("double")).alias("_y"))
    )
    sizes = curve.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    checked = sizes.withColumn(
        "_ok", F.when(F.col("_m") > max_points, F.raise_error(F.lit("x is not a discrete axis")))
    ).where(F.col("_ok").isNull()).drop("_ok")
    small = stage(attach(curve, checked, by, "inner") if by else curve)
    points = small.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("pts")
    )
    grid = points.select(*by, "pts", F.explode(at).alias("x0"), F.lit(-1).alias("j"))
    if with_se:
        own = points.select(*by, "pts", F.posexplode("pts").alias("j", "p")).select(
            *by, "pts", F.col("p.x").alias("x0"), "j"
        )
        grid = grid.unionByName(own)
    rows = _operator_rows(grid, span)
    fit = F.aggregate(
        F.zip_with("pts", "l", lambda p, w: p["y"] * w), F.lit(0.0), lambda a, v: a + v
    )
    norm2 = F.aggregate("l", F.lit(0.0), lambda a, v: a + v * v)
    inside = F.col("x0").between(F.col("pts")[0]["x"], F.element_at("pts", -1)["x"])
    rows = rows.select(
        *by, "x0", "j", F.when(inside, fit).alias("fit"), norm2.alias("norm2"),
        F.when(F.col("j") >= 0, F.get("l", F.col("j"))).alias("own"),
        F.when(F.col("j") >= 0, F.get("pts", F.col("j"))["y"]).alias("yj"),
    )
    out = rows.where("j < 0").select(*by, F.col("x0").alias("x"), "fit", "norm2")
    if not with_se:
        return out.drop("norm2")
    rows = rows.withColumn("_one", F.lit(1))
    scale = rows.where("j >= 0").groupBy(*by, "_one").agg(
        F.sqrt(
            F.try_divide(
                F.sum((F.col("yj") - F.col("fit")) ** 2), F.sum(1 - 2 * F.col("own") + F.col("norm2"))
            )
        ).alias("sigma")
    )
    joined = null_safe(out.withColumn("_one", F.lit(1)), scale, by + ["_one"])
    se = F.when(F.col("fit").isNotNull(), F.col("sigma") * F.sqrt("norm2"))
    return joined.select(*by, "x", "fit", se.alias("se"))


def _operator_rows(grid: DataFrame, span: float) -> DataFrame:
    """Adds ``l``: the weight of every point in the fit at ``x0``."""
    n = F.size("pts")
    q = F.least(n, F.greatest(F.floor(n * span + 1e-5).cast("int"), F.lit(1)))
    dist = F.array_sort(F.transform("pts", lambda p: F.abs(p["x"] - F.col("x0"))))
    reach = F.element_at(dist, q)
    tri = F.transform(
        "pts",
        lambda p: F.when(
            F.abs(p["x"] - F.col("x0")) < F.col("h"),
            F.pow(1 - F.pow(F.abs(p["x"] - F.col("x0")) / F.col("h"), 3), 3),
        ).otherwise(0.0),
    )
    weighted = grid.withColumn("h", reach).withColumn("w", tri)

    def moment(k: int) -> Column:
        terms = F.zip_with("pts", "w", lambda p, w: w * F.pow(p["x"] - F.col("x0"), k))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    s = weighted.withColumns({f"s{k}": moment(k) for k in range(5)})
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    a0, a1, a2 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    det = s0 * a0 + s1 * a1 + s2 * a2
    coef = s.withColumns(
        {"c0": F.try_divide(a0, det), "c1": F.try_divide(a1, det), "c2": F.try_divide(a2, det)}
    )
    u = lambda p: p["x"] - F.col("x0")
    l = F.zip_with(
        "pts", "w",
        lambda p, w: w * (F.col("c0") + F.col("c1") * u(p) + F.col("c2") * u(p) * u(p)),
    )
    return coef.withColumn("l", l)
