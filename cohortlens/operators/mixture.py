"""Normal mixtures of log signals: distributed EM, accelerated to Newton steps, all signals in the same passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.staging import null_safe, stage
from cohortlens.functions.sums import array_sums


@dataclass
class Mixture:
    """Components of one signal, sorted by mean; ``se`` holds the errors of weights, means and variances."""

    signal: str
    weight: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    loglik: float = float("nan")
    n: float = 0.0
    passes: int = 0
    converged: bool = False
    se: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def pass_sums(x: np.ndarray, m: Mixture) -> np.ndarray:
    """What a pass adds up over the values of one signal.

    Log-likelihood and count; per component the responsibilities times the powers 0 to 4 of the standardised value;
    the outer product of each value's score in (log weight ratios, means, log variances).
    """
    k, sd = len(m.weight), np.sqrt(m.variance)
    z = (x[:, None] - m.mean) / sd
    with np.errstate(divide="ignore"):
        logs = np.log(m.weight) - np.log(sd * np.sqrt(2 * np.pi)) - 0.5 * z * z
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    total = like.sum(axis=1, keepdims=True)
    r = like / total
    powers = [r]
    for _ in range(4):
        powers.append(powers[-1] * z)
    score = np.concatenate([(r - m.weight)[:, : k - 1], powers[1] / sd, 0.5 * (powers[2] - r)], axis=1)
    return np.concatenate([
        [np.sum(top + np.log(total)), len(x)], *[p.sum(axis=0) for p in powers], (score.T @ score).ravel()
    ])


def em_step(sums: np.ndarray, m: Mixture, floor: float = 0.0) -> Mixture:
    """The EM update from the sums of a pass; variances stay at or above ``floor``."""
    k = len(m.weight)
    m0, m1, m2 = (sums[2 + i * k : 2 + (i + 1) * k] for i in range(3))
    safe = np.maximum(m0, 1e-300)
    shift = np.sqrt(m.variance) * m1 / safe
    variance = np.maximum(m.variance * m2 / safe - shift**2, floor)
    return Mixture(m.signal, m0 / sums[1], m.mean + shift, variance)


def _derivatives(sums: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, observed information, complete-data information) in (log weight ratios, means, log variances)."""
    k = len(m.weight)
    q = 3 * k - 1
    n, w, v, sd = sums[1], m.weight, m.variance, np.sqrt(m.variance)
    m0, m1, m2, m3, m4 = sums[2 : 2 + 5 * k].reshape(5, k)
    ru, rh = m1 / sd, 0.5 * (m2 - m0)
    gradient = np.concatenate([(m0 - n * w)[: k - 1], ru, rh])
    complete, spread = np.zeros((q, q)), np.zeros((q, q))
    a, mu, la = slice(0, k - 1), np.arange(k - 1, 2 * k - 1), np.arange(2 * k - 1, q)
    lead, shift = w[: k - 1], np.eye(k)[: k - 1] - w[: k - 1, None]
    complete[a, a] = n * (np.diag(lead) - np.outer(lead, lead))
    complete[mu, mu], complete[la, la] = m0 / v, 0.5 * m2
    complete[mu, la] = complete[la, mu] = ru
    cross = np.outer(m0[: k - 1], lead)
    spread[a, a] = np.diag(m0[: k - 1]) - cross - cross.T + n * np.outer(lead, lead)
    spread[a, k - 1 : 2 * k - 1], spread[a, 2 * k - 1 :] = shift * ru, shift * rh
    spread[k - 1 :, a] = spread[a, k - 1 :].T
    spread[mu, mu], spread[la, la] = m2 / v, 0.25 * (m4 - 2 * m2 + m0)
    spread[mu, la] = spread[la, mu] = 0.5 * (m3 - m1) / sd
    return gradient, complete - spread + sums[2 + 5 * k :].reshape(q, q), complete


def _moved(m: Mixture, step: np.ndarray, floor: float) -> Mixture:
    k = len(m.weight)
    logs = np.log(np.maximum(m.weight, 1e-300)) + np.append(step[: k - 1], 0.0)
    w = np.exp(logs - logs.max())
    return Mixture(
        m.signal, w / w.sum(), m.mean + step[k - 1 : 2 * k - 1],
        np.maximum(m.variance * np.exp(step[2 * k - 1 :]), floor),
    )


class _Climb:
    """The search of one signal: where it is, the best place so far and how far to trust the curvature there.

    A step solves ((1 - t) observed + t complete information) for the gradient: t = 1 is the EM step, which never
    falls, t = 0 the Newton step.  t falls after every pass that gained and rises after one that lost, which starts
    again from the best place.  Components that hold less than one value, and variances at their floor, rest.
    """

    def __init__(self, start: Mixture, floor: float):
        self.now, self.floor, self.t = start, floor, 1.0
        self.best: Mixture | None = None

    def take(self, sums: np.ndarray, tol: float) -> bool:
        """Use the sums of a pass at ``now``; true when the search is over."""
        gained = self.best is None or sums[0] >= self.best.loglik - 1e-12 * abs(sums[0])
        passes = self.now.passes + 1
        if gained:
            self.best, self.sums = self.now, sums
            self.best.loglik, self.best.n = sums[0], sums[1]
            self.derived = _derivatives(sums, self.best)
            self.t = self.t / 8 if self.t > 1e-3 else 0.0
            if self._settled(tol):
                self.best.converged, self.best.passes = True, passes
                return True
        else:
            self.t = min(1.0, 8 * self.t + 0.02)
        self.now = self._next()
        self.now.passes = self.best.passes = passes
        return False

    def _free(self) -> np.ndarray:
        k = len(self.best.weight)
        held = self.best.weight * self.best.n >= 1
        floor = self.best.variance <= self.floor * (1 + 1e-9)
        return np.concatenate([(held & held[-1])[: k - 1], held, held & ~(floor & (self.derived[0][2 * k - 1 :] <= 0))])

    def _solve(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(step, variances) over the free parameters; None unless the matrix is safely positive there."""
        free = np.flatnonzero(self._free())
        part = matrix[np.ix_(free, free)]
        scale = np.sqrt(np.maximum(np.diag(self.derived[2])[free], 1e-300))
        part = part / np.outer(scale, scale)
        values, vectors = np.linalg.eigh(part)
        if values[0] <= 1e-9 * max(values[-1], 1.0):
            return None
        inverse = (vectors / values) @ vectors.T / np.outer(scale, scale)
        step, spread = np.zeros(len(matrix)), np.zeros(len(matrix))
        step[free], spread[free] = inverse @ self.derived[0][free], np.diag(inverse)
        return step, spread

    def _settled(self, tol: float) -> bool:
        newton = self._solve(self.derived[1])
        if newton is None:
            return False
        step, spread = newton
        error = np.sqrt(spread)
        if np.any(np.abs(step) > tol * error):
            return False
        k, w = len(self.best.weight), self.best.weight
        # errors of the weights by the delta method; those of single ratios come from the whole inverse
        free = np.flatnonzero(self._free())
        cov = np.zeros((len(step), len(step)))
        cov[np.ix_(free, free)] = np.linalg.inv(self.derived[1][np.ix_(free, free)])
        turn = (np.diag(w) - np.outer(w, w))[:, : k - 1]
        weight = np.sqrt(np.maximum(np.diag(turn @ cov[: k - 1, : k - 1] @ turn.T), 0))
        self.best.se = weight, error[k - 1 : 2 * k - 1], error[2 * k - 1 :] * self.best.variance
        return True

    def _next(self) -> Mixture:
        gradient, observed, complete = self.derived
        t, k = self.t, len(self.best.weight)
        while t < 1:
            found = self._solve((1 - t) * observed + t * complete)
            if found is not None:
                self.t = t
                unit = np.concatenate([np.ones(k - 1), 1 / np.sqrt(self.best.variance), np.ones(k)])
                size = np.abs(found[0] * unit).max()
                return _moved(self.best, found[0] * min(1.0, 1.0 / max(size, 1e-300)), self.floor)
            t = 2 * t + 0.02
        self.t = 1.0
        return em_step(self.sums, self.best, self.floor)


def _signals(df: DataFrame, components: dict[str, int], log: bool) -> DataFrame:
    """One row per person, a column x0, x1, … per signal; missing and non-positive signals are null."""
    return df.select(
        *[(F.ln(c) if log else F.col(c)).cast("double").alias(f"x{i}") for i, c in enumerate(components)]
    )


def fit_mixtures(
    df: DataFrame, components: dict[str, int], log: bool = True, max_passes: int = 400, tol: float = 1e-3,
    start: dict[str, Mixture] | None = None, em_steps: int | None = None,
) -> list[Mixture]:
    """Fit a normal mixture per signal column; missing and non-positive signals are left out.

    The signals are staged once, side by side.  Components start at even quantiles (or from ``start``); every pass
    over the values gives all signals still moving their EM update, gradient and observed information, a few hundred
    numbers each, whatever the number of rows.  A signal has converged when a full Newton step would move no
    parameter by more than ``tol`` of its standard error; a fit that does not within ``max_passes`` says so in
    ``converged``.  With ``em_steps`` exactly so many plain EM steps are taken.  A signal without two different
    values raises.
    """
    order = {s: f"x{i}" for i, s in enumerate(components)}
    values = stage(_signals(df, components, log))
    facts = values.agg(*[
        e.alias(f"{name}{c}")
        for s, c in order.items() for name, e in (
            ("n", F.count(c)), ("v", F.var_samp(c)),
            ("m", F.percentile_approx(c, [(i + 0.5) / components[s] for i in range(components[s])], 10_000)),
        )
    ]).first()
    climbs: dict[str, _Climb] = {}
    for s, c in order.items():
        if not facts[f"v{c}"]:
            raise ValueError(f"{s}: a mixture needs at least two different values")
        k, spread = components[s], facts[f"v{c}"]
        first = (start or {}).get(s) or Mixture(
            s, np.full(k, 1 / k), np.array(facts[f"m{c}"], dtype=float), np.full(k, spread / k)
        )
        climbs[s] = _Climb(first, 1e-6 * spread)
    running = dict(climbs)
    for _ in range(max_passes if em_steps is None else em_steps):
        now = {s: climb.now for s, climb in running.items()}

        def sums(batch: pd.DataFrame, now=now) -> dict[str, np.ndarray]:
            held = {s: batch[order[s]].to_numpy(dtype=float) for s in now}
            return {s: pass_sums(x[~np.isnan(x)], now[s]) for s, x in held.items()}

        totals = array_sums(values, sums)
        for s, climb in list(running.items()):
            if em_steps is not None:
                climb.best = climb.now
                climb.now = em_step(totals[s], climb.now, climb.floor)
                climb.now.loglik, climb.now.n, climb.now.passes = totals[s][0], totals[s][1], climb.best.passes + 1
                climb.best = climb.now
            elif climb.take(totals[s], tol):
                del running[s]
        if not running:
            break
    out = []
    for climb in climbs.values():
        m = climb.best
        rank = np.argsort(m.mean)
        m.weight, m.mean, m.variance = m.weight[rank], m.mean[rank], m.variance[rank]
        m.se = tuple(e[rank] for e in m.se) if m.se else None
        out.append(m)
    return out


def mixture_table(df: DataFrame, fits: list[Mixture]) -> DataFrame:
    """Components with the fit statistics of their signal."""
    rows = []
    for m in fits:
        q = 3 * len(m.weight) - 1
        for i, (w, mu, v) in enumerate(zip(m.weight, m.mean, m.variance)):
            rows.append(
                (
                    m.signal, i + 1, float(w), float(mu), float(v), int(m.n), float(-2 * m.loglik),
                    float(-2 * m.loglik + 2 * q), float(-2 * m.loglik + q * np.log(m.n)),
                    int(m.passes), bool(m.converged),
                )
            )
    return df.sparkSession.createDataFrame(
        rows,
        "signal string, component int, weight double, mean double, variance double, n bigint, "
        "minus2ll double, aic double, bic double, passes int, converged boolean",
    )


def mixture_density(df: DataFrame, fits: list[Mixture], log: bool = True, bins: int = 100) -> DataFrame:
    """Observed density per bin of the (log) signal beside the fitted mixture density."""
    x = lambda c: F.ln(c) if log else F.col(c)
    items = F.array(
        *[F.struct(F.lit(m.signal).alias("signal"), x(m.signal).cast("double").alias("x")) for m in fits]
    )
    values = df.select(F.explode(items).alias("v")).select("v.signal", "v.x").where("x is not null")
    span = stage(
        values.groupBy("signal").agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")
        )
    )
    width = (F.col("hi") - F.col("lo")) / float(bins)
    index = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))
    counted = null_safe(values, span, ["signal"], "inner").groupBy("signal", index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    mid = F.col("lo") + (F.col("bin") + 0.5) * width
    fitted, converged = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for m in fits:
        converged = F.when(F.col("signal") == m.signal, F.lit(bool(m.converged))).otherwise(converged)
        terms = [
            float(w / np.sqrt(2 * np.pi * v)) * F.exp(-((F.col("mid") - float(mu)) ** 2) / (2 * float(v)))
            for w, mu, v in zip(m.weight, m.mean, m.variance)
        ]
        fitted = F.when(F.col("signal") == m.signal, sum(terms, F.lit(0.0))).otherwise(fitted)
    joined = null_safe(grid, counted, ["signal", "bin"]).withColumn("mid", mid)
    return joined.select(
        "signal", "bin", "mid", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * width)).alias("density"),
        fitted.alias("fitted"), converged.alias("converged"),
    )
