"""Design-based estimation for a stratified two-stage survey (ultimate-cluster variance).

One scan of the persons gives weighted sums per (domain, stratum, cluster).  Those cells are
staged; every estimate, standard error and interval is computed from them, so no person row is
shuffled and a hot cluster is reduced on the map side.  Weight normalisation within clusters is
applied to the cells as one factor per cluster instead of joining it back to the persons.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.nulls import ratio
from cohortlens.functions.quantiles import select_values
from cohortlens.functions.staging import null_safe, stage
from cohortlens.functions.tails import Z95, t_ppf
from cohortlens.operators.tables import cross_table, share_of_total

_H, _I = "_stratum", "_psu"



@dataclass(frozen=True)
class Design:
    """Names of the design columns of ``df``; ``rescale`` makes weights sum to n per cluster."""

    df: DataFrame
    strata: str
    psu: str
    weight: str
    rescale: bool = False
    lonely: str = "adjust"

    def with_df(self, df: DataFrame) -> "Design":
        return Design(df, self.strata, self.psu, self.weight, self.rescale, self.lonely)


def survey_design(
    df: DataFrame, strata: str, psu: str, weight: str, rescale: bool = False,
    lonely: str = "adjust", nest: bool = False, check: bool = True,
) -> Design:
    """Declare a design.

    Clusters that occur in several strata and missing weights are errors: at once with ``check``
    (one scan), and in any case in every estimate, whose cells show them without another scan.
    With ``nest`` cluster numbers restart in every stratum.  ``lonely`` says what a stratum with a single cluster adds:
    "adjust" (squared distance to the grand mean), "remove", "certainty" (nothing) or "fail".
    """
    if lonely not in ("adjust", "remove", "certainty", "fail"):
        raise ValueError(f"unknown rule for single-cluster strata: {lonely}")
    if nest:
        df = df.withColumn("_nested_psu", F.struct(strata, psu))
        psu = "_nested_psu"
    design = Design(df, strata, psu, weight, rescale, lonely)
    if check:
        facts = design_summary(design).first()
        _raise_faults(facts["n_null_weight"], facts["n_split_psu"])
    return design


def _raise_faults(n_null_weight: int, n_split_psu: int) -> None:
    if n_null_weight:
        raise ValueError(f"{n_null_weight} rows have no weight: filter them first")
    if n_split_psu:
        raise ValueError(f"{n_split_psu} clusters lie in several strata: use nest=True")


def design_summary(design: Design) -> DataFrame:
    """Rows, strata, clusters, single-cluster strata, split clusters and missing weights."""
    d = design
    psu = d.df.groupBy(d.psu, d.strata).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(d.weight).isNull()).alias("n_null")
    )
    per_psu = psu.groupBy(d.psu).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.count(F.lit(1)).alias("k"),
        F.min(d.strata).alias("h"),
    )
    per_stratum = per_psu.groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("k") > 1).alias("split"),
    )
    return per_stratum.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_strata"),
        F.sum("clusters").alias("n_psu"), F.min("clusters").alias("min_psu_per_stratum"),
        F.max("clusters").alias("max_psu_per_stratum"),
        F.count_if(F.col("clusters") == 1).alias("n_lonely"),
        F.sum("split").alias("n_split_psu"), F.sum("n_null").alias("n_null_weight"),
    )


# ---- shared machinery -------------------------------------------------------------------------


@dataclass(frozen=True)
class _Cells:
    """Staged cell sums with design facts: PSUs per stratum, PSU and stratum counts."""

    table: DataFrame
    strata: DataFrame
    n_psu: int
    n_strata: int
    n_lonely: int


def _cells(design: Design, by: list[str], outcomes: dict[str, Column]) -> _Cells:
    """Σw and Σwy per (by, stratum, cluster) and outcome; rows with a missing outcome add nothing."""
    d = design
    w = F.col(d.weight).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("_w"),
        F.count_if(w.isNull()).alias("_u"),
    ]
    for i, y in enumerate(outcomes.values()):
        y = y.cast("double")
        aggs += [
            F.count(y).alias(f"_c{i}"),
            F.coalesce(F.sum(F.when(y.isNotNull(), w)), F.lit(0.0)).alias(f"_w{i}"),
            F.coalesce(F.sum(w * y), F.lit(0.0)).alias(f"_y{i}"),
        ]
    table = stage(
        d.df.groupBy(*by, F.col(d.strata).alias(_H), F.col(d.psu).alias(_I)).agg(*aggs)
    )
    psu = table.groupBy(_H, _I).agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.sum("_u").alias("u")
    )
    clusters = psu.groupBy(_I).agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("k"))
    faults = clusters.agg(F.sum("u").alias("u"), F.count_if(F.col("k") > 1).alias("k")).first()
    _raise_faults(faults["u"], faults["k"])
    if d.rescale:
        factor = psu.select(_H, _I, (F.col("n") / F.col("w")).alias("_f"))
        table = null_safe(table, factor, [_H, _I], "inner")
    else:
        table = table.withColumn("_f", F.lit(1.0))
    strata = psu.groupBy(_H).agg(F.count(F.lit(1)).alias("_nh"))
    facts = strata.agg(
        F.sum("_nh").alias("p"), F.count(F.lit(1)).alias("h"),
        F.count_if(F.col("_nh") == 1).alias("l"),
    ).first()
    if d.lonely == "fail" and facts["l"]:
        raise ValueError(f"{facts['l']} strata have a single cluster")
    return _Cells(table, strata, facts["p"], facts["h"], facts["l"])


def _scaled(cells: DataFrame, by: list[str], count: int) -> DataFrame:
    """Cell sums with the weight factor of their cluster applied."""
    sums = []
    for i in range(count):
        sums += [
            F.col(f"_c{i}"), (F.col(f"_w{i}") * F.col("_f")).alias(f"_w{i}"),
            (F.col(f"_y{i}") * F.col("_f")).alias(f"_y{i}"),
        ]
    return cells.select(*by, _H, _I, *sums)


def _estimate(
    design: Design, cells: _Cells, wide: DataFrame, by: list[str], names: list[str], stat: str
) -> DataFrame:
    """Estimate and standard error per ``by`` and outcome.

    ``wide`` has one row per (by, stratum, cluster) with the count, Σw and Σwy of every outcome.
    The variance of a ratio needs only the covariance of the cluster sums (Y, N):
    Var(Y/N) = (A - 2 R B + R² C) / N², hence one pass and no join of the estimate to the cells.
    Clusters without a row of the domain enter through the number of clusters per stratum.
    """
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("outcome"), F.col(f"_c{i}").alias("c"), F.col(f"_w{i}").alias("sw"),
                F.col(f"_y{i}").alias("sy"),
            )
            for i, n in enumerate(names)
        ]
    )
    long = wide.select(*by, _H, F.explode(items).alias("o")).select(*by, _H, "o.*")
    by = [*by, "outcome"]
    y, n = F.col("sy"), F.col("sw")
    per_h = long.groupBy(*by, _H).agg(
        F.sum("c").alias("c"), F.sum(y).alias("ty"), F.sum(n).alias("tw"),
        F.sum(y * y).alias("YY"), F.sum(y * n).alias("YN"), F.sum(n * n).alias("NN"),
    )
    per_h = null_safe(per_h, cells.strata, [_H], "inner")
    nh = F.col("_nh").cast("double")
    many = F.col("_nh") > 1
    scale = F.try_divide(nh, nh - 1)

    def centred(cross: str, a: str, b: str) -> Column:
        return F.sum(F.when(many, scale * (F.col(cross) - F.col(a) * F.col(b) / nh)).otherwise(0.0))

    def lonely(name: str) -> Column:
        return F.sum(F.when(~many, F.col(name)).otherwise(0.0))

    total = per_h.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum("ty").alias("sy"), F.sum("tw").alias("sw"),
        centred("YY", "ty", "ty").alias("A"), centred("YN", "ty", "tw").alias("B"),
        centred("NN", "tw", "tw").alias("C"),
        lonely("ty").alias("lY"), lonely("tw").alias("lN"), lonely("YY").alias("lYY"),
        lonely("YN").alias("lYN"), lonely("NN").alias("lNN"),
    )
    return _ratio(total, design, cells, by, stat)


def _ratio(total: DataFrame, design: Design, cells: _Cells, by: list[str], stat: str) -> DataFrame:
    """Estimate and error from the sums A, B, C of the clusters and those of single-cluster strata (l…)."""
    if design.lonely == "adjust":
        k, lone = F.lit(float(cells.n_psu)), F.lit(float(cells.n_lonely))
        my, mn = F.col("sy") / k, F.col("sw") / k
        a = F.col("A") + F.col("lYY") - 2 * my * F.col("lY") + lone * my * my
        b = F.col("B") + F.col("lYN") - my * F.col("lN") - mn * F.col("lY") + lone * my * mn
        c = F.col("C") + F.col("lNN") - 2 * mn * F.col("lN") + lone * mn * mn
    else:
        a, b, c = F.col("A"), F.col("B"), F.col("C")
    if stat == "total":
        est, var = F.col("sy"), a
    else:
        est = ratio(F.col("sy"), F.col("sw"))
        var = F.try_divide(a - 2 * est * b + est * est * c, F.col("sw") * F.col("sw"))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return total.select(*by, "n", est.alias("estimate"), se.alias("se"))


def _interval(df: DataFrame, vartype: tuple[str, ...]) -> DataFrame:
    if "ci" in vartype:
        df = df.withColumn("ci_low", F.col("estimate") - Z95 * F.col("se")).withColumn(
            "ci_high", F.col("estimate") + Z95 * F.col("se")
        )
    if "cv" in vartype:
        df = df.withColumn("cv", F.try_divide("se", "estimate"))
    if "rse" in vartype:
        df = df.withColumn("rse", F.try_divide("se", "estimate") * 100)
    return df if "se" in vartype else df.drop("se")


def _columns(outcomes: list[str] | dict[str, Column]) -> dict[str, Column]:
    return outcomes if isinstance(outcomes, dict) else {o: F.col(o) for o in outcomes}


# ---- estimators ---------------------------------------------------------------------------------


def survey_mean(
    design: Design, outcomes: list[str] | dict[str, Column], by: list[str] = (),
    vartype: tuple[str, ...] = ("se", "ci"), stat: str = "mean",
) -> DataFrame:
    """Weighted means with standard errors, per domain and outcome, in one scan.

    Rows with a missing outcome are left out while their clusters stay in the design.
    """
    by, outcomes = list(by), _columns(outcomes)
    cells = _cells(design, by, outcomes)
    wide = _scaled(cells.table, by, len(outcomes))
    return _interval(_estimate(design, cells, wide, by, list(outcomes), stat), vartype)


def survey_total(
    design: Design, outcomes: list[str] | dict[str, Column], by: list[str] = (),
    vartype: tuple[str, ...] = ("se", "ci"),
) -> DataFrame:
    """Weighted totals with standard errors."""
    return survey_mean(design, outcomes, by, vartype, stat="total")


def survey_levels(
    design: Design, column: str, levels: list | None = None, by: list[str] = (),
    vartype: tuple[str, ...] = ("se", "ci"),
) -> DataFrame:
    """Weighted share of every level of a categorical column, in every domain of ``by``.

    Levels are rows, not columns, so there may be thousands: one scan sums them by level, stratum and cluster.
    """
    by, key = list(by), [*by, column]
    cells = _cells(design, key, {})
    table = cells.table.where(F.col(column).isNotNull()).withColumn("sy", F.col("_w") * F.col("_f"))
    cluster = table.groupBy(*by, _H, _I).agg(F.sum("_n").alias("c"), F.sum("sy").alias("sw"))
    y, w = F.col("sy"), F.col("sw")
    # a cluster without a level adds nothing to A and B, so only levels that occur in it have a row
    level_h = null_safe(table, cluster.drop("c"), [*by, _H, _I], "inner").groupBy(*key, _H).agg(
        F.sum(y).alias("ty"), F.sum(y * y).alias("YY"), F.sum(y * w).alias("YN")
    )
    domain_h = stage(null_safe(
        cluster.groupBy(*by, _H).agg(F.sum("c").alias("c"), F.sum(w).alias("tw"), F.sum(w * w).alias("NN")),
        cells.strata, [_H], "inner",
    ))
    nh, many = F.col("_nh").cast("double"), F.col("_nh") > 1
    scale = F.try_divide(nh, nh - 1)

    def centred(cross: str, a: str, b: str) -> Column:
        return F.sum(F.when(many, scale * (F.col(cross) - F.col(a) * F.col(b) / nh)).otherwise(0.0))

    def lonely(name: str) -> Column:
        return F.sum(F.when(~many, F.col(name)).otherwise(0.0))

    sums = {
        "sy": F.sum("ty"), "A": centred("YY", "ty", "ty"), "B": centred("YN", "ty", "tw"), "lY": lonely("ty"),
        "lYY": lonely("YY"), "lYN": lonely("YN"),
    }
    per_level = null_safe(level_h, domain_h.drop("c", "NN"), [*by, _H], "inner").groupBy(*key).agg(
        *[e.alias(name) for name, e in sums.items()]
    )
    per_domain = domain_h.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum("tw").alias("sw"), centred("NN", "tw", "tw").alias("C"),
        lonely("tw").alias("lN"), lonely("NN").alias("lNN"),
    )
    kind = design.df.schema[column].dataType
    if levels:
        grid = per_domain.withColumn(column, F.explode(F.array(*[F.lit(v).cast(kind) for v in levels])))
    else:
        grid = per_domain.crossJoin(table.select(column).distinct())  # the result has these rows
    total = null_safe(grid, per_level, key).fillna(0.0, list(sums))
    total = total.withColumn("level", F.col(column).cast("string")).drop(column)
    return _interval(_ratio(total, design, cells, [*by, "level"], "mean"), vartype)


def survey_sweep(
    design: Design, outcomes: list[str], domains: list[str],
    vartype: tuple[str, ...] = ("se", "ci", "rse"),
) -> DataFrame:
    """All outcomes by all one-column domains from one scan of the persons."""
    cells = _cells(design, domains, _columns(outcomes))
    wide = _scaled(cells.table, domains, len(outcomes))
    items = F.array(
        *[F.struct(F.lit(d).alias("domain"), F.col(d).cast("string").alias("level")) for d in domains]
    )
    sums = [c for c in wide.columns if c[:2] in ("_c", "_w", "_y")]
    spread = (
        wide.select(F.explode(items).alias("d"), _H, _I, *sums)
        .groupBy("d.domain", "d.level", _H, _I).agg(*[F.sum(c).alias(c) for c in sums])
    )
    return _interval(_estimate(design, cells, spread, ["domain", "level"], outcomes, "mean"), vartype)


def survey_table(design: Design, columns: list[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Weighted one- or two-way table, zero-filled, with the share of the grand total."""
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    cells = _cells(design, columns, {})
    freq = (
        cells.table.where(complete).groupBy(*columns)
        .agg(F.sum(F.col("_w") * F.col("_f")).alias("freq"))
    )
    if len(columns) > 1:
        freq = cross_table(freq, columns, levels, value=F.col("freq"), out="freq")
    return share_of_total(freq, "freq", "prop")


def survey_quantiles(
    design: Design, column: str, probs: list[float] = (0, 0.25, 0.5, 0.75, 1), level: float = 0.95
) -> DataFrame:
    """Weighted quantiles: the smallest value whose weighted distribution reaches p.

    The interval inverts the distribution at p ± t·se, with se the design-based error of the share
    of persons at or below the quantile.  Values are selected by narrowing enclosures, so persons are
    not shuffled; rows without weight or value hold no mass.
    """
    probs = list(probs)
    d = design
    cells = _cells(d, [], {})
    rows = d.df.where(F.col(column).isNotNull()).select(
        F.lit(0).alias("_whole"), (F.col(column).cast("double") + 0.0).alias("_x"),
        F.col(d.strata).alias(_H), F.col(d.psu).alias(_I), F.col(d.weight).cast("double").alias("_m"),
    )
    if d.rescale:
        factor = cells.table.select(_H, _I, "_f")
        rows = null_safe(rows, factor, [_H, _I], "inner").withColumn("_m", F.col("_m") * F.col("_f"))
    values = stage(rows.where("_m > 0").select("_whole", "_x", _H, _I, "_m"))
    span = stage(values.groupBy("_whole").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_size"), F.sum("_m").alias("_w"),
    ))
    head = span.first()
    if head is None:
        raise ValueError(f"{column}: no row with a value and a weight")

    def invert(ps: list[float]) -> list[float]:
        goals = [(i, min(max(p, 0.0), 1.0) * head["_w"] * (1 - 1e-12)) for i, p in enumerate(ps)]
        targets = d.df.sparkSession.createDataFrame(goals, "_t int, _goal double").withColumn("_whole", F.lit(0))
        got = select_values(values.select("_whole", "_x", "_m"), targets, ["_whole"], span.drop("_w")).collect()
        found = {r["_t"]: r["_v"] for r in got}
        return [found[i] for i in range(len(ps))]

    points = invert(probs)
    sums = []
    for i, q in enumerate(points):
        under = F.sum(F.when(F.col("_x") <= F.lit(q), F.col("_m")).otherwise(0.0))
        sums += [F.count(F.lit(1)).alias(f"_c{i}"), F.sum("_m").alias(f"_w{i}"), under.alias(f"_y{i}")]
    wide = values.groupBy(_H, _I).agg(*sums)
    names = [str(i) for i in range(len(points))]
    spread = _estimate(design, cells, wide, [], names, "mean").select("outcome", "se").collect()
    se = {int(r["outcome"]): r["se"] for r in spread}
    t = t_ppf(0.5 + level / 2, cells.n_psu - cells.n_strata)
    low = invert([p - t * se[i] for i, p in enumerate(probs)])
    high = invert([p + t * se[i] for i, p in enumerate(probs)])
    kind = design.df.schema[column].dataType
    out = design.df.sparkSession.createDataFrame(
        [(float(p), q, a, b, se[i]) for i, (p, q, a, b) in enumerate(zip(probs, points, low, high))],
        "p double, quantile double, ci_low double, ci_high double, se double",
    )
    return out.withColumns({c: F.col(c).cast(kind) for c in ("quantile", "ci_low", "ci_high")})


def area_counts(design: Design, area: str, outcomes: list[str]) -> DataFrame:
    """Rows and weighted positives per area, the input of the area smoother."""
    cells = _cells(design, [area], _columns(outcomes))
    aggs = [F.sum("_n").alias("n")]
    aggs += [F.sum(F.col(f"_y{i}") * F.col("_f")).alias(f"n_{o}") for i, o in enumerate(outcomes)]
    return cells.table.groupBy(area).agg(*aggs)
