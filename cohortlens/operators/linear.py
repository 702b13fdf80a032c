"""Simple regression and correlation from one pass of co-moments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.staging import null_safe
from cohortlens.functions.tails import Z95, f_p, t_p, t_ppf


def _moments(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    y, x = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"),
        F.regr_avgy(y, x).alias("mean_y"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )


def _fit(m: DataFrame) -> DataFrame:
    n, sxx, syy, sxy = (F.col(c) for c in ("n", "sxx", "syy", "sxy"))
    slope = F.try_divide(sxy, sxx)
    rss = F.greatest(syy - slope * sxy, F.lit(0.0))
    fit = m.withColumn("slope", slope).withColumn("sigma", F.sqrt(F.try_divide(rss, n - 2.0)))
    return fit.withColumns(
        {
            "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
            "se_slope": F.col("sigma") / F.sqrt("sxx"),
            "se_intercept": F.col("sigma")
            * F.sqrt(1.0 / n + F.try_divide(F.col("mean_x") * F.col("mean_x"), sxx)),
            "r2": F.try_divide(sxy * sxy, sxx * syy),
        }
    )


def ols(df: DataFrame, x: str, y: str, by: list[str] = (), p_values: bool = True) -> DataFrame:
    """Least squares of ``y`` on ``x``: coefficients, errors, t, F, R² and p-values."""
    by = list(by)
    fit = _fit(_moments(df, x, y, by))
    out = fit.withColumns(
        {
            "t_slope": F.try_divide("slope", "se_slope"),
            "t_intercept": F.try_divide("intercept", "se_intercept"),
            "f_value": F.try_divide(F.col("slope") * F.col("sxy"), F.col("sigma") * F.col("sigma")),
            "df": F.col("n") - 2,
        }
    )
    out = out.select(
        *by, "n", "intercept", "slope", "se_intercept", "se_slope", "t_intercept", "t_slope",
        "r2", "sigma", "f_value", "df",
    )
    if not p_values:
        return out
    return out.withColumns(
        {
            "p_intercept": t_p(F.col("t_intercept"), F.col("df")),
            "p_slope": t_p(F.col("t_slope"), F.col("df")),
            "p_model": f_p(F.col("f_value"), F.lit(1.0), F.col("df")),
        }
    )


def regression_line(
    df: DataFrame, x: str, y: str, by: list[str] = (), points: int = 80, level: float = 0.95
) -> DataFrame:
    """Fitted line with its confidence band on an even grid over the range of ``x``.

    The normal point is replaced by the t point of the residual degrees of freedom.
    """
    by = list(by)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = both.groupBy(*by).agg(
        F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi")
    )
    fit = _fit(_moments(both, x, y, by))
    fit = null_safe(fit, span, by, "inner") if by else _one_row(fit, span)
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    quantile = F.pandas_udf(_t_point(level), "double")(F.col("n") - 2)
    se = F.col("sigma") * F.sqrt(
        1.0 / F.col("n") + F.try_divide((F.col("x") - F.col("mean_x")) ** 2, F.col("sxx"))
    )
    return (
        grid.withColumn("x", at)
        .withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("se", se)
        .withColumn("_t", quantile)
        .select(
            *by, "x", "fit", "se", (F.col("fit") - F.col("_t") * F.col("se")).alias("ci_low"),
            (F.col("fit") + F.col("_t") * F.col("se")).alias("ci_high"), "r2",
        )
    )


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    key = F.lit(1)
    return null_safe(a.withColumn("_k", key), b.withColumn("_k", key), ["_k"], "inner").drop("_k")


def _t_point(level: float):
    def point(df: pd.Series) -> pd.Series:
        known = {d: t_ppf(0.5 + level / 2, d) if d > 0 else None for d in df.unique()}
        return df.map(known).astype("float64")

    return point


def correlation_test(df: DataFrame, x: str, y: str, by: list[str] = (), p_values: bool = True):
    """Pearson correlation with t statistic and Fisher interval, on pairs complete in both."""
    by = list(by)
    m = _moments(df, x, y, by)
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    z = F.atanh("r")
    half = Z95 / F.sqrt(F.col("n") - 3.0)
    out = m.select(*by, "n", r.alias("r")).select(
        *by, "n", "r",
        (F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") ** 2))).alias("t"),
        (F.col("n") - 2).alias("df"), F.tanh(z - half).alias("ci_low"),
        F.tanh(z + half).alias("ci_high"),
    )
    return out.withColumn("p", t_p(F.col("t"), F.col("df"))) if p_values else out
