"""Seroconversion (lambda) and seroreversion (rho) by age: the reversible catalytic model.

Persons are reduced once to counts per (group, age).  The posterior of (lambda, rho) is computed
on a grid for all groups together: every group row is expanded to its grid lines, so the work is
spread by group and line, and no person is read again.  The cells of one line live only inside an
Arrow batch; a task sends back one number per line.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import constants as K
from cohortlens.functions.nulls import ratio
from cohortlens.functions.quantiles import exact_quantiles
from cohortlens.functions.staging import null_safe, stage
from cohortlens.functions.tails import Z95

AGES = tuple(range(1, 15))
GROUP = ["antigen", "stratifier", "level"]
_TAIL = 1e-5


# ---- expressions ----------------------------------------------------------------------------


def seroprevalence(age: Column, lam: Column, rho: Column) -> Column:
    """Expected share of positives at an age."""
    total = lam + rho
    return lam / total * (1 - F.exp(-total * age))


def log_prior(lam: Column, rho: Column) -> Column:
    """Uniform prior of both rates on an open interval, a large penalty per violated bound."""
    inside = lambda x: (x > 0) & (x < K.PRIOR_UPPER)
    part = lambda x: F.when(inside(x), math.log(1 / K.PRIOR_UPPER)).otherwise(K.PRIOR_PENALTY)
    return part(lam) + part(rho)


def _log_lik(lam: Column, rho: Column, ages=AGES) -> Column:
    """Bernoulli log-likelihood from the count columns ``n_<age>`` and ``k_<age>``.

    The factors of the prevalence that do not depend on age are taken out of the sum over ages.
    """

    total = lam + rho

    def term(a: int) -> Column:
        n, k, decay = F.col(f"n_{a}"), F.col(f"k_{a}"), F.expm1(-total * float(a))
        return k * F.ln(-decay) + (n - k) * F.ln(rho + lam * (1 + decay))

    tested, positive = (reduce(Column.__add__, [F.col(f"{c}_{a}") for a in ages]) for c in "nk")
    return reduce(Column.__add__, [term(a) for a in ages]) + positive * F.ln(lam) - tested * F.ln(total)


# ---- data reduction ---------------------------------------------------------------------------


def wilson_age_bins(
    df: DataFrame, pos: str, by: list[str] = (), age: str = "age", width: int = 2, upper: int = 14
) -> DataFrame:
    """Share of positives per right-closed age bin with its Wilson interval and plotting age."""
    a = F.col(age)
    rows = df.where((a > 0) & (a <= upper) & F.col(pos).isNotNull())
    binned = rows.groupBy(*by, F.ceil(a / width).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(pos).cast("double")).alias("k")
    )
    n, p, z2 = F.col("n").cast("double"), F.col("k") / F.col("n"), Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return binned.select(
        *by, "bin", ((F.col("bin") - 1) * width + (width + 1) / 2).cast("double").alias("midpoint"), "n",
        F.col("k").cast("long").alias("k"), p.alias("p"), (centre - half).alias("ci_low"),
        (centre + half).alias("ci_high"),
    )


def serostatus_counts(
    df: DataFrame, outcomes: list[str], stratifiers: list[str], age: str = "age"
) -> DataFrame:
    """Positives and tested persons per antigen, stratum level and age (age above 0).

    Persons are counted once over all stratifiers; the overall and one-way strata are sums of
    those few cells.
    """
    sums = []
    for i, o in enumerate(outcomes):
        sums += [F.count(o).alias(f"_n{i}"), F.sum(F.col(o).cast("long")).alias(f"_k{i}")]
    cells = df.where(F.col(age) > 0).groupBy(*stratifiers, age).agg(*sums)
    strata = F.array(
        F.struct(F.lit("overall").alias("s"), F.lit("all").alias("l")),
        *[F.struct(F.lit(s).alias("s"), F.col(s).cast("string").alias("l")) for s in stratifiers],
    )
    antigens = F.array(
        *[
            F.struct(
                F.lit(o).alias("a"), F.col(f"_n{i}").alias("n"),
                F.coalesce(F.col(f"_k{i}"), F.lit(0)).alias("k"),
            )
            for i, o in enumerate(outcomes)
        ]
    )
    spread = cells.select("*", F.explode(strata).alias("g")).where("g.l is not null")
    spread = spread.select(F.col(age).alias("age"), "g", F.explode(antigens).alias("a"))
    return spread.groupBy(
        F.col("a.a").alias("antigen"), F.col("g.s").alias("stratifier"), F.col("g.l").alias("level"),
        "age",
    ).agg(F.sum("a.n").alias("n"), F.sum("a.k").alias("k")).where("n > 0")


def counts_by_age_columns(counts: DataFrame, ages=AGES) -> DataFrame:
    """One row per group with ``n_<age>`` and ``k_<age>``; an age outside ``ages`` is an error."""
    known = F.col("age").isin(*ages)
    bad = F.raise_error(F.lit("age outside the modelled ages")).cast("long")
    aggs = [F.sum(F.when(known, 0).otherwise(bad)).alias("_checked")]
    for a in ages:
        at = F.col("age") == a
        aggs += [
            F.sum(F.when(at, F.col("n")).otherwise(0)).alias(f"n_{a}"),
            F.sum(F.when(at, F.col("k")).otherwise(0)).alias(f"k_{a}"),
        ]
    return counts.groupBy(*GROUP).agg(*aggs).where("_checked = 0").drop("_checked")


def log_likelihood(counts: DataFrame, lam: float, rho: float, ages=AGES) -> DataFrame:
    """Log-likelihood and log-prior of one parameter pair for every group."""
    x, y = F.lit(float(lam)), F.lit(float(rho))
    return counts_by_age_columns(counts, ages).select(
        *GROUP, _log_lik(x, y, ages).alias("loglike"), log_prior(x, y).alias("prior")
    )


# ---- posterior on a grid ------------------------------------------------------------------------


def _line_log_weights(own, is_lam, lo, hi, n, k, ages, cells):
    """Log of likelihood times cell area along the grid lines of a batch, shape (lines, cells)."""
    other = np.exp(lo[:, None] + (np.arange(cells) + 0.5) * ((hi - lo) / cells)[:, None])
    own = own[:, None]
    lam, rho = np.where(is_lam[:, None], own, other), np.where(is_lam[:, None], other, own)
    total = lam + rho
    out = (k.sum(1)[:, None] + 1) * np.log(lam) + np.log(rho) - n.sum(1)[:, None] * np.log(total)
    for i, age in enumerate(ages):
        decay = np.expm1(-total * age)
        out += k[:, i, None] * np.log(-decay)
        out += (n[:, i, None] - k[:, i, None]) * np.log(rho + lam * (1 + decay))
    return out


def _line_masses(ages, cells: int):
    """Arrow function: log of the total weight of each grid line."""

    def masses(
        own: pd.Series, is_lam: pd.Series, lo: pd.Series, hi: pd.Series, n: pd.Series, k: pd.Series
    ) -> pd.Series:
        parts = []
        for at in range(0, len(own), 512):
            cut = slice(at, at + 512)
            w = _line_log_weights(
                own[cut].to_numpy(), is_lam[cut].to_numpy(dtype=bool), lo[cut].to_numpy(),
                hi[cut].to_numpy(), np.vstack(n[cut]).astype(float),
                np.vstack(k[cut]).astype(float), ages, cells,
            )
            top = w.max(axis=1)
            parts.append(top + np.log(np.exp(w - top[:, None]).sum(axis=1)))
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return F.pandas_udf(masses, "double")


def _axis(axis: str, index: Column, cells: int) -> Column:
    """Value at a (fractional) grid index of a log-spaced axis."""
    lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
    return F.exp(lo + index * (hi - lo) / F.lit(float(cells)))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _marginals(boxed: DataFrame, cells: int, ages) -> DataFrame:
    """Normalised marginal masses of both rates with running totals, ``cells`` rows per axis."""
    lines = boxed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn(
        "parameter", F.explode(F.array(F.lit("lambda"), F.lit("rho")))
    )
    lines = lines.repartition(_tasks(boxed), *GROUP, "parameter", "cell")
    lam = F.col("parameter") == "lambda"

    def at(index: Column) -> Column:
        return F.when(lam, _axis("lam", index, cells)).otherwise(_axis("rho", index, cells))

    weighed = lines.select(
        *GROUP, "parameter", "cell", at(F.col("cell")).alias("low"),
        at(F.col("cell") + 1).alias("high"),
        _line_masses(ages, cells)(
            at(F.col("cell") + 0.5), lam,
            F.when(lam, F.col("rho_lo")).otherwise(F.col("lam_lo")),
            F.when(lam, F.col("rho_hi")).otherwise(F.col("lam_hi")),
            F.array(*[F.col(f"n_{a}") for a in ages]), F.array(*[F.col(f"k_{a}") for a in ages]),
        ).alias("logw"),
    )
    one = Window.partitionBy(*GROUP, "parameter")
    run = one.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    w = weighed.withColumn("w", F.exp(F.col("logw") - F.max("logw").over(one)))
    return w.select(
        *GROUP, "parameter", "cell", "low", "high",
        (F.col("w") / F.sum("w").over(one)).alias("mass"),
        F.coalesce(F.sum("w").over(run) / F.sum("w").over(one), F.lit(0.0)).alias("before"),
    )


def _box(counts: DataFrame, lo: float) -> DataFrame:
    edges = {f"{a}_{s}": math.log(v) for a in ("lam", "rho") for s, v in
             (("lo", lo), ("hi", K.PRIOR_UPPER))}
    return counts.withColumns({c: F.lit(v) for c, v in edges.items()})


def posterior_box(
    counts: DataFrame, coarse: int = 200, ages=AGES, lowest: float = 1e-5
) -> DataFrame:
    """Group rows with the log box that holds all but 1e-5 of each tail of both marginals."""
    wide = stage(counts_by_age_columns(counts, ages))
    m = _marginals(_box(wide, lowest), coarse, ages)
    after = F.col("before") + F.col("mass")

    def bound(name: str, end: str) -> Column:
        mine = F.col("parameter") == name
        if end == "lo":
            return F.ln(F.min(F.when(mine & (after > _TAIL), F.col("low"))))
        return F.ln(F.max(F.when(mine & (F.col("before") < 1 - _TAIL), F.col("high"))))

    box = m.groupBy(*GROUP).agg(
        bound("lambda", "lo").alias("lam_lo"), bound("lambda", "hi").alias("lam_hi"),
        bound("rho", "lo").alias("rho_lo"), bound("rho", "hi").alias("rho_hi"),
    )
    return stage(null_safe(wide, box, GROUP, "inner"))


def posterior_marginals(
    counts: DataFrame, cells: int = 200, ages=AGES, coarse: int | None = None
) -> DataFrame:
    """Marginal posterior of both rates: a first log-spaced grid finds the box, a second fills it."""
    return _marginals(posterior_box(counts, coarse or cells, ages), cells, ages)


def posterior_marginals_one_pass(
    counts: DataFrame, cells: int = 200, ages=AGES, lowest: float = 1e-5
) -> DataFrame:
    """The same on one grid over the whole prior range, for quick looks."""
    return _marginals(_box(stage(counts_by_age_columns(counts, ages)), lowest), cells, ages)


def posterior_summary(marginals: DataFrame, probs=(0.025, 0.5, 0.975)) -> DataFrame:
    """Interpolated quantiles of both rates: lower limit, median, upper limit."""
    names = ["low", "median", "high"] if len(probs) == 3 else [f"q{i}" for i in range(len(probs))]
    picks = []
    for name, p in zip(names, probs):
        hit = (F.col("before") < p) & (F.col("before") + F.col("mass") >= p)
        at = F.col("low") + (p - F.col("before")) / F.col("mass") * (F.col("high") - F.col("low"))
        picks.append(F.max(F.when(hit, at)).alias(name))
    return marginals.groupBy(*GROUP, "parameter").agg(*picks)


def seroconversion(
    df: DataFrame, outcomes: list[str], stratifiers: list[str], age: str = "age", cells: int = 200,
    ages=AGES,
) -> DataFrame:
    """Posterior summary of both rates for every antigen, overall and per stratum level."""
    counts = serostatus_counts(df, outcomes, stratifiers, age)
    return posterior_summary(posterior_marginals(counts, cells, ages))


def posterior_density(marginals: DataFrame) -> DataFrame:
    """Marginal density per grid cell with its region: lower tail, middle or upper tail."""
    mid = F.col("before") + F.col("mass") / 2
    return marginals.select(
        *GROUP, "parameter", "cell", ((F.col("low") + F.col("high")) / 2).alias("x"),
        (F.col("mass") / (F.col("high") - F.col("low"))).alias("density"),
        F.when(mid < 0.025, "lower").when(mid > 0.975, "upper").otherwise("middle").alias("region"),
    )


def posterior_curve(summary: DataFrame, upper: int = 14) -> DataFrame:
    """Model curve at ages 0 to ``upper``, at the medians and at the marginal limits."""
    wide = summary.groupBy(*GROUP).agg(
        *[
            F.max(F.when(F.col("parameter") == p, F.col(q))).alias(f"{p}_{q}")
            for p in ("lambda", "rho") for q in ("low", "median", "high")
        ]
    )
    grid = wide.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(upper))))
    return grid.select(
        *GROUP, "age",
        *[
            seroprevalence(F.col("age"), F.col(f"lambda_{q}"), F.col(f"rho_{q}")).alias(name)
            for q, name in (("median", "fit"), ("low", "fit_low"), ("high", "fit_high"))
        ],
    )


# ---- posterior draws ------------------------------------------------------------------------------


def _uniform(seed: int, *keys) -> Column:
    """Number in (0, 1) that depends only on the keys, so retried tasks agree."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(2**52))
    return (h.cast("double") + 0.5) / float(2**52)


def _conditional_rho(ages, cells: int):
    """Arrow function: rho for each uniform number of a lambda line, by inverting its cells."""

    def invert(
        own: pd.Series, lo: pd.Series, hi: pd.Series, n: pd.Series, k: pd.Series, us: pd.Series
    ) -> pd.Series:
        out = []
        for at in range(0, len(own), 512):
            cut = slice(at, at + 512)
            lows, highs = lo[cut].to_numpy(), hi[cut].to_numpy()
            logw = _line_log_weights(
                own[cut].to_numpy(), np.ones(len(lows), dtype=bool), lows, highs,
                np.vstack(n[cut]).astype(float), np.vstack(k[cut]).astype(float), ages, cells,
            )
            w = np.exp(logw - logw.max(axis=1, keepdims=True))
            after = np.cumsum(w, axis=1) / w.sum(axis=1, keepdims=True)
            for line, u, low, high in zip(after, us[cut], lows, highs):
                edges = np.concatenate([[0.0], line])
                index = np.interp(u, edges, np.arange(cells + 1))
                out.append(np.exp(low + index * (high - low) / cells))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(invert, "array<double>")


def posterior_draws(
    counts: DataFrame, draws: int = 8000, cells: int = 200, ages=AGES, seed: int = 42
) -> DataFrame:
    """Draws of (lambda, rho) with log-likelihood and log-prior, one stratified sample per group.

    Draw m is placed at a random point of the m-th of ``draws`` equal slices of the cumulative
    lambda mass, so every grid line finds its draws from its own mass interval, without a range
    join; rho is then drawn along the line.
    """
    boxed = posterior_box(counts, cells, ages)
    lines = _marginals(boxed, cells, ages).where(F.col("parameter") == "lambda")
    end = F.col("before") + F.col("mass")
    first = F.greatest(F.floor(F.col("before") * draws).cast("int") - 1, F.lit(0))
    last = F.least(F.floor(end * draws).cast("int") + 1, F.lit(draws - 1))
    tried = lines.where((F.col("mass") > 0) & (first <= last)).withColumn(
        "draw", F.explode(F.sequence(first, last))
    )
    u = (F.col("draw") + _uniform(seed, *GROUP, "draw")) / float(draws)
    # the last line is open upwards, so rounding of the running mass loses no draw
    until = F.when(F.col("cell") == cells - 1, 1.0).otherwise(end)
    placed = (
        tried.withColumn("u", u)
        .where((F.col("u") > F.col("before")) & (F.col("u") <= until))
        .withColumn("inner", (F.col("u") - F.col("before")) / F.col("mass"))
        .withColumn("v", _uniform(seed + 1, *GROUP, "draw"))
    )
    by_line = placed.groupBy(*GROUP, "cell").agg(
        F.collect_list(F.struct("draw", "inner", "v")).alias("d")
    )
    ready = null_safe(by_line, boxed, GROUP, "inner").repartition(_tasks(boxed), *GROUP, "cell")
    rho = _conditional_rho(ages, cells)(
        _axis("lam", F.col("cell") + 0.5, cells), F.col("rho_lo"), F.col("rho_hi"),
        F.array(*[F.col(f"n_{a}") for a in ages]), F.array(*[F.col(f"k_{a}") for a in ages]),
        F.col("d.v"),
    )
    drawn = (
        ready.withColumn("rhos", rho)
        .withColumn("z", F.explode(F.arrays_zip("d", "rhos")))
        .withColumn("lam", _axis("lam", F.col("cell") + F.col("z.d.inner"), cells))
        .withColumn("rho", F.col("z.rhos"))
    )
    return drawn.select(
        *GROUP, F.col("z.d.draw").alias("draw"), F.col("lam").alias("lambda"), "rho",
        _log_lik(F.col("lam"), F.col("rho"), ages).alias("loglike"),
        log_prior(F.col("lam"), F.col("rho")).alias("prior"),
    )


def draw_summary(draws: DataFrame, columns=("lambda", "rho", "loglike")) -> DataFrame:
    """Count, mean, deviation, median and 95 % range of every drawn quantity."""
    items = F.array(*[F.struct(F.lit(c).alias("q"), F.col(c).alias("x")) for c in columns])
    long = draws.select(*GROUP, F.explode(items).alias("d")).select(
        *GROUP, F.col("d.q").alias("quantity"), F.col("d.x").alias("x")
    )
    keys = [*GROUP, "quantity"]
    q = exact_quantiles(long, "x", [0.025, 0.5, 0.975], keys)
    m = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return null_safe(q, m, keys, "inner").select(
        *keys, "n", "mean", "sd", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("high"),
    )


def draw_band(draws: DataFrame, upper: int = 14) -> DataFrame:
    """Pointwise 95 % band of the model curve from the draws."""
    at = draws.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(upper)))).withColumn(
        "sp", seroprevalence(F.col("age"), F.col("lambda"), F.col("rho"))
    )
    q = exact_quantiles(at, "sp", [0.025, 0.5, 0.975], [*GROUP, "age"])
    return q.select(
        *GROUP, "age", F.col("q")[1].alias("fit"), F.col("q")[0].alias("fit_low"),
        F.col("q")[2].alias("fit_high"),
    )


def kernel_density(
    df: DataFrame, value: str, by: list[str], points: int = 512, fine: int = 1024
) -> DataFrame:
    """Gaussian kernel density on an even grid reaching three bandwidths past the data.

    Rows are first spread linearly over a fine grid, so the kernel sum runs over ``fine`` masses
    per group however many rows there are.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    q = exact_quantiles(rows, "_x", [0, 0.25, 0.75, 1], by)
    sd = rows.groupBy(*by).agg(F.stddev_samp("_x").alias("sd"))
    s = null_safe(q, sd, list(by), "inner")
    iqr = (F.col("q")[2] - F.col("q")[1]) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    facts = stage(
        s.withColumn("bw", 0.9 * spread * F.pow(F.col("n"), -0.2)).select(
            *by, "n", "bw", (F.col("q")[0] - 3 * F.col("bw")).alias("lo"),
            (F.col("q")[3] + 3 * F.col("bw")).alias("hi"),
        )
    )
    step = (F.col("hi") - F.col("lo")) / float(fine - 1)
    pos = (F.col("_x") - F.col("lo")) / step
    k, part = F.floor(pos), pos - F.floor(pos)
    two = F.array(
        F.struct(k.alias("k"), (1 - part).alias("w")), F.struct((k + 1).alias("k"), part.alias("w"))
    )
    mass = (
        null_safe(rows, facts, list(by), "inner")
        .select(*by, F.explode(two).alias("m"))
        .groupBy(*by, F.col("m.k").alias("k")).agg(F.sum("m.w").alias("w"))
        .where("w > 0")
    )
    grid = null_safe(stage(mass), facts, list(by), "inner").withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    at = F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / float(points - 1)
    z = (at - (F.col("lo") + F.col("k") * step)) / F.col("bw")
    kernel = F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.groupBy(*by, F.col("g").alias("point"), at.alias("x")).agg(
        F.sum(kernel).alias("density")
    )


def seroconversion_vs_infection(
    rates: DataFrame, infection: DataFrame, key: str, antigen: str, stratifier: str
) -> DataFrame:
    """Median seroconversion rate of an area level joined to an infection prevalence table."""
    scr = rates.where(
        (F.col("antigen") == antigen) & (F.col("stratifier") == stratifier)
        & (F.col("parameter") == "lambda")
    ).select(F.col("level").alias(key), F.col("median").alias("scr"))
    return null_safe(infection.withColumn(key, F.col(key).cast("string")), scr, [key], "inner")
