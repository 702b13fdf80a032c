"""Logistic models as distributed sums: maximum likelihood, bias-reduced, sweeps, separation.

Rows are first collapsed to covariate patterns with counts, staged once.  Every iteration is one
pass over the patterns that returns p x p sums for all models still running; the p x p algebra is
the only thing done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.staging import distinct_levels, stage
from cohortlens.functions.sums import array_sums
from cohortlens.functions.tails import Z95, norm_sf

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Factor:
    """Categorical term; the first sorted level is the reference."""

    column: str
    levels: tuple | None = None


def factor(column: str, levels: Iterable | None = None) -> Factor:
    return Factor(column, tuple(sorted(levels)) if levels else None)


@dataclass(frozen=True)
class Square:
    """Squared numeric term."""

    column: str


Term = str | Factor | Square


@dataclass
class Model:
    """Outcome, terms and, once fitted, coefficients with their covariance."""

    model_id: str
    outcome: str
    terms: list[Term]
    kind: str = "ml"
    coding: list[tuple[str, str, str, object]] = field(default_factory=list)
    beta: np.ndarray | None = None
    vcov: np.ndarray | None = None
    information: np.ndarray | None = None
    loglik: float = float("nan")
    n: float = 0.0
    events: float = 0.0
    steps: int = 0
    converged: bool = False
    se_path: list[np.ndarray] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(_column(t) for t in self.terms))

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.coding]


def _column(term: Term) -> str:
    return term if isinstance(term, str) else term.column


def coding(df: DataFrame, model: Model, known: dict) -> list[tuple[str, str, str, object]]:
    """Design columns as (name, column, kind, level): intercept, numbers, non-reference levels."""
    out = [(INTERCEPT, "", "one", None)]
    for term in model.terms:
        if isinstance(term, Factor):
            if term.levels is None and term.column not in known:
                known[term.column] = distinct_levels(df, term.column)
            levels = term.levels or known[term.column]
            out += [(f"{term.column}[{v}]", term.column, "level", v) for v in levels[1:]]
        elif isinstance(term, Square):
            out.append((f"{term.column}^2", term.column, "square", None))
        else:
            out.append((term, term, "number", None))
    return out


def design_columns(model: Model) -> list[Column]:
    """The design matrix as column expressions, intercept first."""
    out = []
    for _, column, kind, level in model.coding:
        x = F.col(column) if column else None
        if kind == "one":
            out.append(F.lit(1.0))
        elif kind == "level":
            out.append(F.when(x == F.lit(level), 1.0).when(x != F.lit(level), 0.0))
        else:
            out.append(x.cast("double") ** 2 if kind == "square" else x.cast("double"))
    return out


def patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct covariate and outcome patterns with their number of rows, staged."""
    columns = list(dict.fromkeys(columns))
    return stage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))


def _matrix(batch: pd.DataFrame, coding) -> np.ndarray:
    x = np.empty((len(batch), len(coding)))
    for i, (_, column, kind, level) in enumerate(coding):
        if kind == "one":
            x[:, i] = 1.0
        elif kind == "level":
            x[:, i] = (batch[column] == level).to_numpy(dtype=float)
        else:
            v = batch[column].to_numpy(dtype=float)
            x[:, i] = v * v if kind == "square" else v
    return x


def _pass(table: DataFrame, models: list[Model], hats: bool = False) -> dict[str, np.ndarray]:
    """One pass: for each model its size, events, log-likelihood, score and information.

    With ``hats`` the score is the bias-reducing one, from the hat values under ``vcov``.
    """
    work = [(m.model_id, m.outcome, m.columns, m.coding, m.beta, m.vcov) for m in models]

    def sums(batch: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {}
        for key, outcome, columns, coding, beta, vcov in work:
            rows = batch.dropna(subset=[outcome, *columns])
            x, y = _matrix(rows, coding), rows[outcome].to_numpy(dtype=float)
            n = rows["_n"].to_numpy(dtype=float)
            eta = x @ beta
            mu = 1 / (1 + np.exp(-eta))
            w = mu * (1 - mu)
            resid = y - mu
            if hats:
                hat = w * np.einsum("ij,jk,ik->i", x, vcov, x)
                resid = resid + hat * (0.5 - mu)
            loglik = np.sum(n * (y * eta - np.logaddexp(0, eta)))
            out[key] = np.concatenate(
                [
                    [n.sum(), np.sum(n * y), loglik], x.T @ (n * resid),
                    ((x * (n * w)[:, None]).T @ x).ravel(),
                ]
            )
        return out

    return array_sums(table, sums)


def fit_models(
    df: DataFrame, models: list[Model], max_steps: int = 60, tol: float = 1e-9,
    collapsed: bool = False,
) -> list[Model]:
    """Fit all models together by scoring steps; rows missing a used column are left out.

    ``kind`` "ml" is maximum likelihood, "firth" the bias-reduced estimate, whose score needs a
    second pass per step for the hat values under the new information.  Steps are limited to 5 per coefficient, so fits stay finite under separation.
    """
    columns = [c for m in models for c in (m.outcome, *m.columns)]
    table = df if collapsed else patterns(df, columns)
    known: dict = {}
    for m in models:
        m.coding = coding(table, m, known)
        m.beta = np.zeros(len(m.coding))
    running = list(models)
    for step in range(max_steps):
        sums = _pass(table, running)
        for m in running:
            p, s = len(m.coding), sums[m.model_id]
            m.information = s[3 + p :].reshape(p, p)
            m.vcov = np.linalg.pinv(m.information, hermitian=True)
            m.se_path.append(np.sqrt(np.maximum(np.diag(m.vcov), 0)))
        reduced = [m for m in running if m.kind == "firth"]
        if reduced:
            sums.update(_pass(table, reduced, hats=True))
        still = []
        for m in running:
            p, s, last = len(m.coding), sums[m.model_id], m.loglik
            m.n, m.events, m.loglik = s[:3]
            m.steps = step + 1
            move = m.vcov @ s[3 : 3 + p]
            move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))
            small = np.abs(move).max() < tol * max(1.0, np.abs(m.beta).max())
            flat = m.kind == "ml" and abs(m.loglik - last) < 1e-12 * (abs(m.loglik) + 0.1)
            m.converged = bool(small or flat)
            if not m.converged:
                m.beta = m.beta + move
                still.append(m)
        running = still
        if not running:
            break
    return models


def fit_logistic(df: DataFrame, outcome: str, terms: list[Term], kind: str = "ml", **kw) -> Model:
    """One logistic model, ``kind`` "ml" or "firth"."""
    return fit_models(df, [Model(outcome, outcome, list(terms), kind)], **kw)[0]


def odds_ratios(df: DataFrame, models: list[Model]) -> DataFrame:
    """Coefficients with Wald tests and intervals, and the odds ratios, one row per term."""
    rows = []
    for m in models:
        for name, b, se in zip(m.names, m.beta, np.sqrt(np.maximum(np.diag(m.vcov), 0))):
            z = b / se if se > 0 else float("nan")
            low, high = b - Z95 * se, b + Z95 * se
            rows.append(
                (
                    m.model_id, m.outcome, name, float(b), float(se), float(z),
                    2 * norm_sf(abs(z)), float(low), float(high), float(np.exp(b)),
                    float(np.exp(low)), float(np.exp(high)), int(m.n), int(m.events),
                    bool(m.converged),
                )
            )
    return df.sparkSession.createDataFrame(
        rows,
        "model_id string, outcome string, term string, estimate double, se double, z double, "
        "p double, ci_low double, ci_high double, odds_ratio double, or_low double, "
        "or_high double, n bigint, events bigint, converged boolean",
    )


def model_sweep(
    df: DataFrame, outcomes: list[str], covariates: list[Term], kind: str = "firth"
) -> list[Model]:
    """One model per outcome and covariate, then the adjusted one, all from the same passes."""
    models = []
    for o in outcomes:
        models += [Model(f"{o}~{_column(t)}", o, [t], kind) for t in covariates]
        models.append(Model(f"{o}~adjusted", o, list(covariates), kind))
    return fit_models(df, models)


def score(df: DataFrame, model: Model) -> DataFrame:
    """Rows used by the model with fitted probability, hat value and residuals."""
    used = df.dropna(subset=[model.outcome, *model.columns])
    x = design_columns(model)
    eta = sum((b * c for b, c in zip(map(float, model.beta), x)), F.lit(0.0))
    y = F.col(model.outcome).cast("double")
    out = used.withColumn("p_hat", 1 / (1 + F.exp(-eta)))
    quad = F.lit(0.0)
    for i, a in enumerate(x):
        for j in range(i + 1):
            quad = quad + float(model.vcov[i, j] * (1 if i == j else 2)) * a * x[j]
    p = F.col("p_hat")
    out = out.withColumns({"resid": y - p, "hat": p * (1 - p) * quad})
    loss = F.when(y == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    return out.withColumns(
        {
            "pearson": F.col("resid") / F.sqrt(p * (1 - p)),
            "deviance": F.signum("resid") * F.sqrt(2 * loss),
        }
    )


def fitted_patterns(df: DataFrame, models: list[Model]) -> DataFrame:
    """(model_id, y, p_hat, hat, n): the outcome and covariate patterns of each model with their fitted probability.

    The rows are collapsed once for all models.  Hat values follow the model's own information, so for a bias-reduced
    fit they are those of the penalised likelihood.
    """
    table = patterns(df, [c for m in models for c in (m.outcome, *m.columns)])
    parts = []
    for m in models:
        scored = score(table, m)
        parts.append(scored.select(
            F.lit(m.model_id).alias("model_id"), F.col(m.outcome).cast("double").alias("y"), "p_hat", "hat",
            F.col("_n").alias("n"),
        ))
    return reduce(DataFrame.union, parts)


# ---- separation ----------------------------------------------------------------------------------


def level_separation(df: DataFrame, outcome: str, factors: list[str]) -> DataFrame:
    """Events and non-events per level; a level with none of either separates the outcome."""
    items = F.array(
        *[F.struct(F.lit(c).alias("term"), F.col(c).cast("string").alias("level")) for c in factors]
    )
    long = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).alias("_y"), F.explode(items).alias("t"))
    out = long.where("t.level is not null").groupBy("t.term", "t.level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("long")).alias("events")
    )
    return out.withColumn("separated", (F.col("events") == 0) | (F.col("events") == F.col("n")))


def range_separation(df: DataFrame, outcome: str, numbers: list[str]) -> DataFrame:
    """Ranges of numeric covariates by outcome; ranges that do not overlap separate it."""
    y = F.col(outcome)
    aggs = []
    for i, c in enumerate(numbers):
        x = F.col(c).cast("double")
        for v in (0, 1):
            aggs += [
                F.min(F.when(y == v, x)).alias(f"_lo{v}_{i}"), F.max(F.when(y == v, x)).alias(f"_hi{v}_{i}")
            ]
    one = df.agg(*aggs)
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("term"),
                *[F.col(f"_{e}{v}_{i}").alias(f"{e}{v}") for v in (0, 1) for e in ("lo", "hi")],
            )
            for i, c in enumerate(numbers)
        ]
    )
    out = one.select(F.explode(items).alias("r")).select("r.*")
    apart = (F.col("hi0") <= F.col("lo1")) | (F.col("hi1") <= F.col("lo0"))
    return out.withColumn("separated", apart)


def fit_separation(df: DataFrame, model: Model, growth: float = 2.0) -> DataFrame:
    """Growth of standard errors over scoring steps; unbounded growth marks a separated term.

    Without separation the errors settle, so the ratio of the last two steps tends to one while
    the ratio to the first stays moderate.
    """
    first, last = model.se_path[min(1, len(model.se_path) - 1)], model.se_path[-1]
    before = model.se_path[-2] if len(model.se_path) > 1 else last
    rows = [
        (model.model_id, n, float(b), float(c / a), float(c / max(d, 1e-300)), bool(c / a > growth and c / d > 1.01))
        for n, b, a, c, d in zip(model.names, model.beta, first, last, before)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "model_id string, term string, estimate double, se_growth double, last_ratio double, "
        "separated boolean",
    )
