"""Diagnostics of fitted models, from rows with an outcome ``y`` and a fitted probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_quantiles, running_totals
from cohortlens.functions.staging import attach, null_safe, stage
from cohortlens.functions.tails import Z95, chi2_p, chi2_sf, norm_sf
from cohortlens.operators.logistic import Factor, Model, Square, fit_models, score


def usable(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def _weight(n: str | None) -> Column:
    return F.col(n).cast("double") if n else F.lit(1)


def goodness_of_fit(
    df: DataFrame, y: str, p: str, n_parameters: int | Column, p_values: bool = True,
    by: list[str] = (), n: str | None = None,
) -> DataFrame:
    """Deviance and Pearson chi-squared against the residual degrees of freedom.

    Rows without an outcome or a fitted probability are left out, here and in the other diagnostics.
    ``by`` keeps several models apart; ``n`` names the number of rows that a row stands for.
    """
    df = usable(df, y, p)
    yc, pc, w = F.col(y).cast("double"), F.col(p), _weight(n)
    loss = F.when(yc == 1, -F.ln(pc)).otherwise(-F.ln(1 - pc))
    k = n_parameters if isinstance(n_parameters, Column) else F.lit(n_parameters)
    out = df.groupBy(*by).agg(
        F.sum(w).cast("long").alias("n"), F.sum(2 * w * loss).alias("deviance"),
        F.sum(w * (yc - pc) ** 2 / (pc * (1 - pc))).alias("pearson"),
    ).withColumn("df", F.col("n") - k)
    if not p_values:
        return out
    return out.withColumns(
        {
            "p_deviance": chi2_p(F.col("deviance"), F.col("df")),
            "p_pearson": chi2_p(F.col("pearson"), F.col("df")),
        }
    )


def parameters_of(models: list[Model], extra: dict[str, int] | None = None) -> Column:
    """Number of coefficients by ``model_id``, for ``goodness_of_fit``; ``extra`` adds variances."""
    pairs = [x for m in models for x in (F.lit(m.model_id), F.lit(len(m.beta) + (extra or {}).get(m.model_id, 0)))]
    return F.create_map(*pairs)[F.col("model_id")]


def hosmer_lemeshow(df: DataFrame, y: str, p: str, groups: int = 10, p_values: bool = True):
    """Observed against expected counts in quantile groups of the fitted probability."""
    df = usable(df, y, p)
    rows = df.select(F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.lit(1).alias("_one"))
    probs = [i / groups for i in range(1, groups)]
    q = exact_quantiles(rows, "_p", probs, ["_one"]).select("_one", "q")
    cut = attach(rows, q, ["_one"], "inner")
    bin_ = sum((F.when(F.col("_p") > F.col("q")[i], 1).otherwise(0) for i in range(groups - 1)), F.lit(0))
    cells = cut.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("o1"), F.sum("_p").alias("e1")
    )
    term = (F.col("o1") - F.col("e1")) ** 2 / F.col("e1") + (F.col("o1") - F.col("e1")) ** 2 / (
        F.col("n") - F.col("e1")
    )
    out = cells.agg(F.sum(term).alias("chisq"), F.count(F.lit(1)).alias("groups")).withColumn(
        "df", F.col("groups") - 2
    )
    return out.withColumn("p", chi2_p(F.col("chisq"), F.col("df"))) if p_values else out


def binned_residuals(
    df: DataFrame, y: str, p: str, bins: int | None = None, reach: float = 2.0, by: list[str] = (), n: str | None = None
) -> DataFrame:
    """Mean residual per equal-count bin of the fitted probability with its error bounds.

    By default floor(sqrt(n)) bins; equal probabilities always share a bin.  ``by`` and ``n`` as in
    ``goodness_of_fit``.
    """
    keys = [*by, "_whole"]
    yc = F.col(y).cast("double")
    rows = df.select(
        *by, F.lit(0).alias("_whole"), F.col(p).alias("_p"), yc.alias("_y"), _weight(n).alias("_n")
    ).where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    # counts and outcomes pack better than residuals, which follow from them at an equal probability
    placed = running_totals(
        rows, "_p",
        {"n": F.sum("_n"), "s": F.sum(F.col("_n") * F.col("_y")), "q": F.sum(F.col("_n") * F.col("_y") ** 2)}, keys,
    )
    k = (F.lit(bins) if bins else F.greatest(F.floor(F.sqrt("n_all")), F.lit(1))).cast("long")
    label = F.least(k - 1, F.ceil((F.col("n_before") + 1) * k / F.col("n_all").cast("double")).cast("long") - 1)
    apart = F.col("s") / F.col("n") - F.col("_p")
    placed = placed.select(
        *by, label.alias("bin"), "_p", "n", (F.col("n") * apart).alias("r1"),
        (F.col("n") * apart * apart + F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).alias("r2"),
    )
    per = placed.groupBy(*by, "bin").agg(
        F.sum("n").alias("_m"), (F.sum(F.col("_p") * F.col("n")) / F.sum("n")).alias("mean_p"),
        (F.sum("r1") / F.sum("n")).alias("mean_resid"),
        F.try_divide(F.sum("r2") - F.sum("r1") ** 2 / F.sum("n"), F.sum("n") - 1).alias("var"),
    ).withColumn("n", F.col("_m").cast("long"))
    se = reach * F.sqrt(F.greatest("var", F.lit(0.0))) / F.sqrt("n")
    return per.select(*by, "bin", "n", "mean_p", "mean_resid", se.alias("bound")).withColumn(
        "inside", F.abs("mean_resid") <= F.col("bound")
    )


def share_inside(binned: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of bins whose mean residual lies within its bounds."""
    return binned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bins"), F.avg(F.col("inside").cast("double")).alias("inside")
    )


def performance(df: DataFrame, y: str, p: str, n_parameters: int) -> DataFrame:
    """AIC, BIC, Tjur's R² and the root mean squared error."""
    df = usable(df, y, p)
    yc, pc = F.col(y).cast("double"), F.col(p)
    ll = F.sum(F.when(yc == 1, F.ln(pc)).otherwise(F.ln(1 - pc)))
    return df.agg(
        F.count(F.lit(1)).alias("n"), ll.alias("loglik"),
        (F.avg(F.when(yc == 1, pc)) - F.avg(F.when(yc == 0, pc))).alias("r2_tjur"),
        F.sqrt(F.avg((yc - pc) ** 2)).alias("rmse"),
    ).withColumns(
        {
            "aic": 2.0 * n_parameters - 2 * F.col("loglik"),
            "bic": F.ln("n") * float(n_parameters) - 2 * F.col("loglik"),
        }
    )


def collinearity(df: DataFrame, *models: Model) -> DataFrame:
    """Generalised variance inflation factor and tolerance per term, from the fitted information.

    Any fit with a covariance will do: likelihood, bias-reduced, or the fixed part of a mixed model.
    """
    rows = []
    for model in models:
        v = model.vcov[1:, 1:]
        d = np.sqrt(np.diag(v))
        r = v / np.outer(d, d)
        columns = [c[1] for c in model.coding[1:]]
        for column in dict.fromkeys(columns):
            own = np.array([c == column for c in columns])
            rest = np.linalg.det(r[np.ix_(~own, ~own)]) if (~own).any() else 1.0
            gvif = np.linalg.det(r[np.ix_(own, own)]) * rest / np.linalg.det(r)
            k = int(own.sum())
            rows.append((model.model_id, column, k, float(gvif), float(gvif ** (1 / (2 * k))), float(1 / gvif),
                         bool(model.converged)))
    return df.sparkSession.createDataFrame(
        rows, "model_id string, term string, df int, vif double, se_factor double, tolerance double, converged boolean"
    )


def residual_trend(scored: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Mean Pearson residual in quantile bins of a covariate; rows without either are left out."""
    rows = usable(scored, column, "pearson").select(
        F.col(column).cast("double").alias("_x"), F.col("pearson").alias("_r"), F.lit(1).alias("_one")
    )
    q = exact_quantiles(rows, "_x", [i / bins for i in range(1, bins)], ["_one"]).select("_one", "q")
    cut = attach(rows, q, ["_one"], "inner")
    bin_ = sum((F.when(F.col("_x") > F.col("q")[i], 1).otherwise(0) for i in range(bins - 1)), F.lit(0))
    return cut.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean_x"), F.avg("_r").alias("mean_pearson")
    )


def curvature_tests(df: DataFrame, model: Model) -> DataFrame:
    """Likelihood-ratio test of an added square for every numeric term, fitted together."""
    numeric = [t for t in model.terms if isinstance(t, str)]
    base = Model("base", model.outcome, list(model.terms), "ml")
    wider = [Model(c, model.outcome, [*model.terms, Square(c)], "ml") for c in numeric]
    fitted = fit_models(df, [base, *wider])
    rows = []
    for m in fitted[1:]:
        rank = np.linalg.matrix_rank(m.information) - np.linalg.matrix_rank(base.information)
        stat = max(2 * (m.loglik - base.loglik), 0.0) if rank > 0 else None
        stat = None if stat is None else float(stat)
        p = None if stat is None else float(chi2_sf(stat, 1))
        rows.append((model.model_id, m.model_id, stat, p, bool(base.converged and m.converged)))
    return df.sparkSession.createDataFrame(
        rows, "model_id string, term string, chisq double, p double, converged boolean"
    )


def outlier_test(scored: DataFrame, key: str) -> DataFrame:
    """Row with the largest studentised residual and its Bonferroni p-value."""
    h = F.col("hat")
    r = F.signum("deviance") * F.sqrt(F.col("deviance") ** 2 + h * F.col("pearson") ** 2 / (1 - h))
    top = scored.select(F.col(key).alias("_k"), r.alias("_r")).agg(
        F.count("_r").alias("n"), F.max(F.struct(F.abs("_r").alias("a"), "_r", "_k")).alias("t")
    )
    from cohortlens.functions.tails import normal_p

    out = top.select("n", F.col("t._k").alias(key), F.col("t._r").alias("rstudent"))
    return out.withColumn("p", normal_p(F.col("rstudent"))).withColumn(
        "p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("n"))
    )
