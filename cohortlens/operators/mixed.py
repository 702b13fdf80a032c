"""Mixed logistic models with random intercepts per cluster, or per household within cluster.

The marginal likelihood is the Laplace approximation at the conditional modes.  Patterns of
(covariates, outcome) per household are staged once and packed by cluster (``mixed_blocks``).  Where a
cluster is too large for that, each step is one Spark job: the patterns meet
the current modes in an equi-join, are summed per household (a hot cluster is reduced on the map
side and split by the join), and the household sums are staged.  A second small job reduces them
to p x p sums, from which coefficients, standard deviations and all modes move together; the new
modes are a projection of the staged sums.

With u, v standard normal effects, the linear predictor is x'beta + s_b v[cluster] + s_c u[household].
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.staging import null_safe, stage
from cohortlens.functions.sums import array_sums
from cohortlens.functions.tails import Z95, norm_sf
from cohortlens.operators.logistic import Model, Term, coding, design_columns, fit_models, patterns
from cohortlens.operators.mixed_blocks import WIDE, Search, Spec, fitted, joint_sums, one_pass, pack, profiles, search


@dataclass
class MixedModel:
    """A fitted mixed model; ``sd`` holds the deviations of the cluster and household effects."""

    fixed: Model
    sd: np.ndarray
    nested: bool
    loglik: float = float("nan")
    steps: int = 0
    converged: bool = False
    fixed_variance: float = float("nan")
    n_clusters: int = 0
    path: list = field(default_factory=list)
    #: (model_id, y, p_hat, n) per pattern, fitted at the conditional modes; models of one sweep share it
    fitted: DataFrame | None = None


_LEVELS = ("_cluster", "_household")


def _kernel(x: np.ndarray, rows: pd.DataFrame, beta: np.ndarray, b: float, c: float):
    """Predictor, weight and residual of pattern rows at the current modes."""
    n, y = rows["_n"].to_numpy(), rows["_y"].to_numpy()
    eta = x @ beta + b * rows["v"].to_numpy() + c * rows["u"].to_numpy()
    mu = 1 / (1 + np.exp(-eta))
    w = n * mu * (1 - mu)
    return w, n * (y - mu), w * (1 - 2 * mu), n * (y * eta - np.logaddexp(0, eta))


def _household_sums(joined: DataFrame, m: MixedModel, p: int) -> DataFrame:
    """Per household: weight, residual, curvature, log-likelihood, and the first three times x.

    Batches are reduced per household before the shuffle; the coefficients travel with the Arrow
    function, so the compiled plan is the same in every step.
    """
    names = [f"x{i}" for i in range(p)]
    sums = ["w", "g", "t", "l", *[f"{k}{i}" for k in "sqr" for i in range(p)]]
    b, c = (float(s) for s in m.sd)
    beta = m.fixed.beta.copy()

    def reduce(batches):
        for rows in batches:
            x = rows[names].to_numpy(dtype=float)
            w, g, t, l = _kernel(x, rows, beta, b, c)
            parts = np.column_stack(
                [w, g, t, l, x * w[:, None], x * t[:, None], x * g[:, None]]
            )
            group = rows.groupby(list(_LEVELS), sort=False)
            codes = group.ngroup().to_numpy()
            total = np.zeros((codes.max() + 1 if len(codes) else 0, parts.shape[1]))
            np.add.at(total, codes, parts)
            out = group[["v", "u"]].first().reset_index()
            yield pd.concat([out, pd.DataFrame(total, columns=sums)], axis=1)

    kinds = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in _LEVELS)
    schema = f"{kinds}, v double, u double, " + ", ".join(f"{k} double" for k in sums)
    partial = joined.mapInPandas(reduce, schema)
    out = partial.groupBy(*_LEVELS, "v", "u").agg(*[F.sum(k).alias(k) for k in sums])
    vectors = [f"array({', '.join(f'{k}{i}' for i in range(p))}) AS {k}" for k in "sqr"]
    return out.selectExpr(*_LEVELS, "v", "u", "w", "g", "t", "l", *vectors)


def _information(joined: DataFrame, m: MixedModel, p: int) -> np.ndarray:
    """X'WX over all rows."""
    names = [f"x{i}" for i in range(p)]
    b, c = (float(s) for s in m.sd)
    beta = m.fixed.beta.copy()

    def sums(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[names].to_numpy(dtype=float)
        w = _kernel(x, rows, beta, b, c)[0]
        return {"xwx": ((x * w[:, None]).T @ x).ravel()}

    return array_sums(joined, sums)["xwx"].reshape(p, p)


def _cluster_sums(households: DataFrame, m: MixedModel, p: int) -> DataFrame:
    """Household quantities reduced to one row per cluster (A, Σ s/D and the rest)."""
    b, c = (float(s) for s in m.sd)
    w, g, u = F.col("w"), F.col("g"), F.col("u")
    d = 1 + c * c * w
    out = households.withColumns({"d": d, "ru": c * g - u})
    return out.groupBy("_cluster", "v").agg(
        F.sum("g").alias("cg"), F.sum(w / F.col("d")).alias("ca"),
        F.sum(w * F.col("ru") / F.col("d")).alias("cwr"),
        F.array(*[F.sum(F.col("s")[i] / F.col("d")) for i in range(p)]).alias("cs"),
        F.sum(w * u / F.col("d")).alias("cwu"),
    )


def _stack(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy())


def _totals(full: DataFrame, m: MixedModel, p: int) -> dict[str, np.ndarray]:
    """Global sums for one joint step, from household rows that carry their cluster's sums."""
    b, c = (float(s) for s in m.sd)
    plain = ["w", "g", "t", "u", "v", "ca", "ch", "cg", "cwr", "cwu", "cwgd", "l"]

    def sums(h: pd.DataFrame) -> dict[str, np.ndarray]:
        columns = {k: h[k].to_numpy(dtype=float) for k in plain} | {k: _stack(h[k]) for k in ("s", "q", "r", "cs")}
        return joint_sums(columns, b, c)

    return array_sums(full, sums)


def _full(households: DataFrame, m: MixedModel, p: int) -> DataFrame:
    """Household rows with the sums of their cluster; trivial when a cluster is one household."""
    c = float(m.sd[1])
    if not m.nested:
        zero = F.lit(0.0)
        return households.withColumns(
            {"cg": F.col("g"), "ca": F.col("w"), "cs": F.col("s"), "cwr": zero, "cwu": zero,
             "cwgd": zero, "ch": F.lit(1)}
        )
    counted = households.groupBy("_cluster").agg(
        F.count(F.lit(1)).alias("ch"), F.sum(F.col("w") * F.col("g") / (1 + c * c * F.col("w"))).alias("cwgd")
    )
    clusters = null_safe(_cluster_sums(households, m, p).drop("v"), counted, ["_cluster"], "inner")
    return null_safe(households, clusters, ["_cluster"], "inner")


def _next_modes(full: DataFrame, m: MixedModel, move: np.ndarray) -> DataFrame:
    """Modes after the joint step in which the coefficients change by ``move``."""
    b, c = (f"{float(s)!r}D" for s in m.sd)
    dot = lambda col: " + ".join(f"{float(x)!r}D * {col}[{i}]" for i, x in enumerate(move))
    dv = f"({b} * cg - v - {b} * {c} * cwr - {b} * ({dot('cs')})) / (1 + {b} * {b} * ca)"
    du = f"({c} * g - u - {c} * (w * {b} * dv + {dot('s')})) / (1 + {c} * {c} * w)"
    return full.selectExpr("*", f"{dv} AS dv").selectExpr(*_LEVELS, "v + dv AS v", f"u + {du} AS u")


def fit_mixed(
    df: DataFrame, outcome: str, terms: list[Term], cluster: str, household: str | None = None,
    sd0: float = 0.5, max_steps: int = 80, tol: float = 1e-3, model_id: str | None = None,
) -> MixedModel:
    """Laplace fit with a random intercept per cluster, and per household within it if given."""
    spec = [(model_id or outcome, outcome, list(terms))]
    return fit_mixed_models(df, spec, cluster, household, sd0, max_steps, tol)[0]


def fit_mixed_models(
    df: DataFrame, models: list[tuple[str, str, list[Term]]], cluster: str, household: str | None = None,
    sd0: float = 0.5, max_steps: int = 80, tol: float = 1e-3, largest_cluster: int = 200_000,
    few_values: int = 4_096,
) -> list[MixedModel]:
    """All (model id, outcome, terms) in the same passes; rows missing a used column of a model are left out of it.

    Patterns are packed by cluster, so that each pass is one map over the packed rows and sends p x p sums to the
    driver.  Where the covariates of a model take about ``few_values`` different rows at most and households have no
    effect of their own, equal clusters are counted and fitted once: what a model adds up over a cluster depends on its
    patterns and counts alone.  Clusters of more than ``largest_cluster`` patterns do not fit a task; then every model is fitted by joins of
    patterns and modes, which split a cluster over many tasks.  Both end at the same optimum.  A variance that the data
    drive to zero ends at a small bound; a fit that does not settle says so in ``converged``.
    """
    fixed = [Model(key, outcome, list(terms), "ml") for key, outcome, terms in models]
    keys = [cluster, *([household] if household else [])]
    columns = list(dict.fromkeys(c for m in fixed for c in (m.outcome, *m.columns)))
    used = df.dropna(subset=keys).select(
        F.col(cluster).alias("_cluster"), (F.col(household) if household else F.lit(0)).alias("_household"), *columns
    )
    collapsed = patterns(used, used.columns)
    most = collapsed.groupBy("_cluster").count().agg(F.max("count")).first()[0] or 0
    if most > largest_cluster:
        return [_fit_by_joins(df, m.outcome, m.terms, cluster, household, sd0, max_steps, tol, m.model_id) for m in fixed]
    # the plain fit and the variance of its predictor do not need the clusters
    overall = stage(collapsed.groupBy(*columns).agg(F.sum("_n").alias("_n")))
    fit_models(overall, fixed, collapsed=True)
    outcomes = list(dict.fromkeys(m.outcome for m in fixed))
    design: dict[tuple, tuple[int, object]] = {}
    for m in fixed:
        for code, column in zip(m.coding, design_columns(m)):
            design.setdefault(code, (len(design), column))
    places = [(outcomes.index(m.outcome), [design[code][0] for code in m.coding]) for m in fixed]
    values = overall.agg(*[F.approx_count_distinct(F.xxhash64(*m.columns)).alias(f"d{i}") for i, m in enumerate(fixed)]).first()
    own = {i: place for i, place in enumerate(places) if not household and values[i] <= few_values}
    ys, xs = [F.col(o) for o in outcomes], [c for _, c in design.values()]
    parts = [profiles(collapsed, ys, xs, own)] if own else []
    if len(own) < len(fixed):
        parts.append(pack(collapsed, ys, xs))
    blocks = reduce(DataFrame.unionAll, parts)
    searches = []
    for i, (m, (outcome, at)) in enumerate(zip(fixed, places)):
        start = m.beta.copy(), np.array([sd0, sd0 if household else 0.0])
        spec = Spec(m.model_id, 0, list(range(len(at))), *start, i) if i in own else Spec(m.model_id, outcome, at, *start, WIDE)
        searches.append(Search(spec, bool(household)))
    search(blocks, searches, len(outcomes), max_steps, tol)
    variance = _predictor_variance(overall, fixed, [s.spec.beta for s in searches])
    scored = fitted(blocks, [s.spec for s in searches], len(outcomes))
    out = []
    for m, s in zip(fixed, searches):
        m.beta, m.information = s.spec.beta, s.information
        m.vcov = np.linalg.pinv(s.information, hermitian=True)
        m.converged = s.converged
        out.append(MixedModel(m, s.spec.sd, bool(household), float(s.loglik), s.steps, s.converged,
                              variance[m.model_id], int(round(s.clusters)), fitted=scored))
    return out


def laplace(
    df: DataFrame, outcome: str, terms: list[Term], cluster: str, beta: list[float], sd: list[float],
    household: str | None = None,
) -> DataFrame:
    """(name, value): Laplace log-likelihood at given parameters, number of clusters, and the gradient in the
    coefficients and the deviations."""
    fixed = Model(outcome, outcome, list(terms))
    columns = [F.col(household) if household else F.lit(0)]
    used = df.dropna(subset=[cluster, *([household] if household else [])]).select(
        F.col(cluster).alias("_cluster"), columns[0].alias("_household"), outcome, *fixed.columns
    )
    collapsed = patterns(used, used.columns)
    fixed.coding = coding(collapsed, fixed, {})
    design = design_columns(fixed)
    blocks = pack(collapsed, [F.col(outcome)], design)
    p = len(design)
    spec = Spec(outcome, 0, list(range(p)), np.array(beta, dtype=float), np.array(sd, dtype=float))
    sums = one_pass(blocks, [spec], 1)[outcome]
    rows = [("loglik", sums[0]), ("clusters", sums[1]), ("sd(cluster)", sums[2])]
    rows += [("sd(household)", sums[3])] if household else []
    rows += list(zip(fixed.names, sums[6 : 6 + p]))
    return df.sparkSession.createDataFrame([(name, float(x)) for name, x in rows], "name string, value double")


def _predictor_variance(collapsed: DataFrame, models: list[Model], betas: list[np.ndarray]) -> dict[str, float]:
    """Variance of the fixed predictor over the rows of each model, all in one pass."""
    sums = []
    for i, (m, beta) in enumerate(zip(models, betas)):
        eta = sum((float(b) * x for b, x in zip(beta, design_columns(m))), F.lit(0.0))
        n = F.when(F.col(m.outcome).isNotNull() & eta.isNotNull(), F.col("_n"))
        sums += [F.sum(n).alias(f"n{i}"), F.sum(n * eta).alias(f"a{i}"), F.sum(n * eta * eta).alias(f"b{i}")]
    got = collapsed.agg(*sums).first()
    return {
        m.model_id: got[f"b{i}"] / got[f"n{i}"] - (got[f"a{i}"] / got[f"n{i}"]) ** 2 for i, m in enumerate(models)
    }


def _fit_by_joins(
    df: DataFrame, outcome: str, terms: list[Term], cluster: str, household: str | None,
    sd0: float, max_steps: int, tol: float, model_id: str,
) -> MixedModel:
    """The fit for clusters of any size.

    Coefficients and modes take Newton steps for the current deviations (X'WX is renewed with
    large change of them); the variances follow their own gradient by scoring steps once the inner
    equations hold.
    """
    fixed = Model(model_id, outcome, list(terms), "ml")
    keys = [cluster, *([household] if household else [])]
    used = df.dropna(subset=[outcome, *fixed.columns, *keys]).select(
        F.col(cluster).alias("_cluster"),
        (F.col(household) if household else F.lit(0)).alias("_household"),
        *dict.fromkeys([outcome, *fixed.columns]),
    )
    collapsed = patterns(used, used.columns)
    fit_models(collapsed, [fixed], collapsed=True)
    p = len(fixed.coding)
    table = collapsed.select(
        *_LEVELS, F.col(outcome).cast("double").alias("_y"), F.col("_n").cast("double").alias("_n"),
        *[x.alias(f"x{i}") for i, x in enumerate(design_columns(fixed))],
    )
    m = MixedModel(fixed, np.array([sd0, sd0 if household else 0.0]), bool(household))
    modes = table.select(*_LEVELS).distinct().withColumns({"v": F.lit(0.0), "u": F.lit(0.0)})
    free = np.array([True, bool(household)])
    inner, change, tried = 0, 1.0, np.array([False, False])
    xwx, last = fixed.information, np.full(2, np.nan)
    for step in range(max_steps):
        m.steps = step + 1
        joined = table.join(modes, list(_LEVELS))
        if inner == 0 and step > 0 and change > 0.3:
            xwx = _information(joined, m, p)
        households = stage(_household_sums(joined, m, p))
        full = _full(households, m, p)
        sums = _totals(full, m, p)
        hessian = xwx + sums["schur"].reshape(p, p)
        fixed.information = hessian
        fixed.vcov = np.linalg.pinv(hessian, hermitian=True)
        move = fixed.vcov @ (sums["grad"] - sums["back"])
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
        m.loglik, clusters, gb, gc, ib, ic = sums["ll"]
        m.n_clusters = int(round(clusters))
        off = np.sqrt(sums["mode"][0] / max(clusters, 1.0))
        moved = np.abs(move / np.sqrt(np.maximum(np.diag(fixed.vcov), 1e-300))).max()
        m.path.append((m.loglik, m.sd.copy(), moved, off))
        inner += 1
        # the gradient of the variances must be clearly finer than their last change
        fine = max(1e-3, 0.05 * change)
        if (moved < fine and off < fine) or inner >= 8:
            # variance scale s = sd²: gradient d loglik / d s = (d loglik / d sd) / (2 sd)
            s = m.sd**2
            g = np.where(free, np.array([gb, gc]) / (2 * np.maximum(m.sd, 1e-150)), 0.0)
            rel = np.abs(g * s)
            at_zero = (m.sd <= 1.01e-3) & (g < 0)
            # all gradients are judged in units of their standard error
            flat = np.all((rel / np.sqrt(np.maximum([ib, ic], 1e-12)))[free & ~at_zero] < tol)
            back_in = free & (m.sd <= 1.01e-3) & (g * 0.005 > 1e-3)
            if flat and moved < 1e-3 and not back_in.any():
                m.converged = True
                break
            if not flat or back_in.any():
                new_s, last = _next_variances(s, g, np.array([ib, ic]), free, tried, last)
                change = float(np.abs(np.log(new_s[free] / np.maximum(s[free], 1e-12))).max())
                scale = np.where(free, np.sqrt(new_s) / np.maximum(m.sd, 1e-150), 1.0)
                modes = _next_modes(full, m, move)
                # keep the predictor contribution sd * effect while the deviation changes
                modes = modes.withColumn("v", F.col("v") / float(scale[0])).withColumn(
                    "u", F.col("u") / float(scale[1])
                )
                fixed.beta = fixed.beta + move
                m.sd = np.where(free, np.sqrt(new_s), 0.0)
                inner = 0
                continue
        modes = _next_modes(full, m, move)
        fixed.beta = fixed.beta + move
    if m.converged:
        xwx = _information(table.join(modes, list(_LEVELS)), m, p)
        fixed.information = xwx + sums["schur"].reshape(p, p)
        fixed.vcov = np.linalg.pinv(fixed.information, hermitian=True)
    eta = sum((float(v) * F.col(f"x{i}") for i, v in enumerate(fixed.beta)), F.lit(0.0))
    moments = table.agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * eta).alias("a"), F.sum(F.col("_n") * eta * eta).alias("b")
    ).first()
    m.fixed_variance = moments["b"] / moments["n"] - (moments["a"] / moments["n"]) ** 2
    b, c = (float(s) for s in m.sd)
    m.fitted = table.join(modes, list(_LEVELS)).select(
        F.lit(model_id).alias("model_id"), F.col("_y").alias("y"),
        (1 / (1 + F.exp(-(eta + b * F.col("v") + c * F.col("u"))))).alias("p_hat"), F.col("_n").alias("n"),
    )
    return m


def mixed_sweep(
    df: DataFrame, outcomes: list[str], covariates: list[Term], cluster: str,
    household: str | None = None, adjusted: bool = False,
) -> list[MixedModel]:
    """One mixed model per outcome and covariate, and on request the adjusted one, all in the same passes."""
    models = []
    for o in outcomes:
        sets = {getattr(t, "column", t): [t] for t in covariates}
        if adjusted:
            sets["adjusted"] = list(covariates)
        models += [(f"{o}~{name}", o, terms) for name, terms in sets.items()]
    return fit_mixed_models(df, models, cluster, household)


def _next_variances(s, g, info, free, tried, last):
    """Scoring step on the log variances, limited to a factor of four, and the step to remember.

    Two successive scoring steps give their ratio and so the limit of the sequence; that longer
    step is taken and the next one starts afresh.  A small variance that still falls is tried at
    the bound once; if the likelihood rises there, it comes back and is followed by steps.
    """
    plain = np.where(free, g * s / np.maximum(info, 1e-12), 0.0)
    ratio = np.clip(np.divide(plain, last, out=np.zeros(2), where=np.abs(np.nan_to_num(last)) > 1e-12), -1, 0.95)
    known = ~np.isnan(last)
    step = np.clip(np.where(known, plain / (1 - ratio), plain), -1.4, 1.4)
    remember = np.where(known | (np.abs(plain) > 1.4), np.nan, plain)
    new = np.maximum(s * np.exp(step), 1e-6)
    jump = free & (g < 0) & (new < 0.03) & ~tried
    tried |= jump
    new = np.where(jump, 1e-6, new)
    return np.where(free & (s <= 1.1e-6) & (g > 0), 0.01, new), remember


def mixed_odds_ratios(df: DataFrame, models: list[MixedModel]) -> DataFrame:
    """Fixed effects with Wald tests and odds ratios, then one row per random-effect deviation."""
    rows = []
    for m in models:
        f = m.fixed
        for name, b, se in zip(f.names, f.beta, np.sqrt(np.maximum(np.diag(f.vcov), 0))):
            z = b / se if se > 0 else float("nan")
            low, high = b - Z95 * se, b + Z95 * se
            rows.append(
                (f.model_id, "fixed", name, float(b), float(se), float(z), 2 * norm_sf(abs(z)),
                 float(np.exp(b)), float(np.exp(low)), float(np.exp(high)), float(m.loglik),
                 int(f.n), m.n_clusters, m.converged)
            )
        for name, sd in zip(("cluster", "household"), m.sd):
            if name == "cluster" or m.nested:
                rows.append(
                    (f.model_id, "random", f"sd({name})", float(sd), None, None, None, None, None,
                     None, float(m.loglik), int(f.n), m.n_clusters, m.converged)
                )
    return df.sparkSession.createDataFrame(
        rows,
        "model_id string, part string, term string, estimate double, se double, z double, p double, "
        "odds_ratio double, or_low double, or_high double, loglik double, n bigint, "
        "clusters int, converged boolean",
    )


def fitted_rows(models: list[MixedModel]) -> DataFrame:
    """(model_id, y, p_hat, n) of all models; those fitted together are read in one pass."""
    return reduce(DataFrame.union, {id(m.fitted): m.fitted for m in models}.values())


def mixed_performance(df: DataFrame, models: list[MixedModel]) -> DataFrame:
    """AIC, BIC, marginal and conditional R², and the intraclass correlation."""
    rows = []
    for m in models:
        k = len(m.fixed.beta) + 1 + int(m.nested)
        random, noise = float(np.sum(m.sd**2)), float(np.pi**2 / 3)
        total = m.fixed_variance + random + noise
        rows.append(
            (m.fixed.model_id, float(-2 * m.loglik + 2 * k), float(-2 * m.loglik + k * np.log(m.fixed.n)),
             float(m.fixed_variance / total), float((m.fixed_variance + random) / total),
             float(random / (random + noise)), bool(m.converged))
        )
    return df.sparkSession.createDataFrame(
        rows,
        "model_id string, aic double, bic double, r2_marginal double, r2_conditional double, icc double, "
        "converged boolean",
    )
