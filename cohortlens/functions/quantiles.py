"""Exact quantiles and running totals that never bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.staging import null_safe, stage


#: Cells into which a range of values is split at a time.
_SPLIT = 1024


def _octave(x: Column) -> Column:
    """Sign and eighth of an octave of a number, in its order; zero is 0."""
    part = F.floor(F.least(F.log2(F.abs(x)) * 8, F.lit(20_000.0))) + 20_000
    return F.when(x > 0, part).when(x < 0, -part).otherwise(F.lit(0)).cast("long")


def select_values(
    values: DataFrame, targets: DataFrame, by: list[str], spans: DataFrame, small: int = 20_000,
    accuracy: int = _SPLIT,
) -> DataFrame:
    """Per target the smallest value whose cumulative mass reaches it, as ``(by, _t, _v)``.

    ``values`` has ``_x`` and its mass ``_m``; ``targets`` has a number ``_t`` and a mass ``_goal``; ``spans`` the
    smallest and largest value ``_lo``, ``_hi`` and the number ``_size`` of values per group.  All enclosures narrow
    together: a pass over the values counts the cells of every enclosure, first by octaves and then by ``accuracy``
    even parts of its range, and each target goes on in the cell that holds it, until no enclosure holds more than
    ``small`` values unless they are equal.  The last pass takes the values inside one by one.  Only cells leave the map
    side, and nothing depends on the accuracy of a sketch.  ``by`` must not be empty; ``values`` should be staged.
    """
    if accuracy < 2:
        raise ValueError("accuracy must be at least 2")
    where = [*by, "_lo", "_hi"]
    at = stage(null_safe(targets, spans, by, "inner").withColumn("_base", F.lit(0.0)))
    first = True
    while True:
        wide = at.where((F.col("_size") > small) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        x = F.col("_x")
        ratio = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        digit = _octave(x) if first else F.least(F.floor(ratio * accuracy), F.lit(accuracy - 1))
        first = False
        cells = _inside(values, wide, by).groupBy(*where, digit.alias("_d")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m"), F.min("_x").alias("_a"), F.max("_x").alias("_b")
        )
        found = _reached(cells, wide, by, "_d").select(
            *by, "_t", "_goal", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_n").alias("_size"),
            F.col("_before").alias("_base"),
        )
        rest = at.where((F.col("_size") <= small) | (F.col("_lo") >= F.col("_hi")))
        at = stage(rest.select(*found.columns).union(found))
    cells = _inside(values, at, by).groupBy(*where, "_x").agg(F.sum("_m").alias("_m"))
    return _reached(cells, at, by, "_x").select(*by, "_t", F.col("_x").alias("_v"))


def _inside(values: DataFrame, at: DataFrame, by: list[str]) -> DataFrame:
    """The values that lie in an enclosure; enclosures of a group are the same or apart."""
    spans = at.select(*by, "_lo", "_hi").distinct()
    return null_safe(values, spans, by, "inner").where(F.col("_x").between(F.col("_lo"), F.col("_hi")))


def _reached(cells: DataFrame, at: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per target the first cell of its enclosure at which the cumulative mass reaches the goal."""
    where = [*by, "_lo", "_hi"]
    line = Window.partitionBy(*where).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = stage(cells.withColumn("_run", F.sum("_m").over(line)))
    tops = run.groupBy(*where).agg(F.max("_run").alias("_top"))
    goals = null_safe(at.select(*where, "_t", "_goal", "_base"), tops, where, "inner")
    # rounding of sums may leave a goal just above all mass; the last cell holds it then
    goals = goals.withColumn("_need", F.least(F.col("_goal") - F.col("_base"), F.col("_top")))
    met = null_safe(run, goals, where, "inner").where(F.col("_run") >= F.col("_need"))
    kept = [c for c in run.columns if c not in (*where, "_run", order)]
    best = met.groupBy(*where, "_t", "_goal", "_base").agg(
        F.min(F.struct(F.col("_run"), F.col(order), *[F.col(c) for c in kept])).alias("_c")
    )
    return best.select(
        *by, "_t", "_goal", F.col(f"_c.{order}").alias(order), *[F.col(f"_c.{c}").alias(c) for c in kept],
        (F.col("_base") + F.col("_c._run") - F.col("_c._m")).alias("_before"),
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] = (), also: dict[str, Column] | None = None,
    small: int = 20_000, accuracy: int = _SPLIT,
) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``(by, n, q array)``.

    ``also`` holds further aggregates of the value (named ``_x``), taken in the first pass; with
    them, groups without any value are kept.  The values are staged once; the order statistics
    come from ``select_values``; ``accuracy`` sets how fast its enclosures narrow, never the result.
    """
    by = list(by)
    keys = by + ["_whole"]
    also = also or {}
    rows = stage(df.select(*by, F.lit(0).alias("_whole"), (F.col(value).cast("double") + 0.0).alias("_x")))
    facts = stage(rows.groupBy(*keys).agg(
        F.count("_x").alias("_size"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        *[e.alias(name) for name, e in also.items()],
    ))
    held = facts.where(F.col("_size") > 0)
    goals = []
    for i, p in enumerate(probs):
        rank = F.floor((F.col("_size") - 1) * F.lit(float(p))) + 1
        for side, goal in enumerate((rank, F.least(rank + 1, F.col("_size")))):
            goals.append(F.struct(F.lit(2 * i + side).alias("_t"), goal.cast("double").alias("_goal")))
    targets = held.select(*keys, F.explode(F.array(*goals)).alias("_g")).select(*keys, "_g.*")
    values = rows.where(F.col("_x").isNotNull()).withColumn("_m", F.lit(1.0))
    chosen = select_values(values, targets, keys, held.select(*keys, "_lo", "_hi", "_size"), small, accuracy)
    wide = chosen.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(f"_v{t}") for t in range(2 * len(probs))]
    )
    q = []
    for i, p in enumerate(probs):
        h = (F.col("_size") - 1) * F.lit(float(p))
        a, b = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        q.append(a + (h - F.floor(h)) * (b - a))
    facts = facts if also else held
    out = null_safe(facts, wide, keys, "left" if also else "inner")
    answer = F.array(*q)
    if also:
        answer = F.when(F.col("_size") > 0, answer)
    return out.select(*by, F.col("_size").alias("n"), *also, answer.alias("q"))


def running_totals(
    df: DataFrame, value: str, sums: dict[str, Column], by: list[str] = ()
) -> DataFrame:
    """Per distinct value: the sums, the totals over all smaller values (``<name>_before``) and over all (``<name>_all``).

    Distinct values are range-partitioned, so a partition holds a slice of the order, ties stay
    together and a large group spreads over many tasks; offsets of the slices are added after.
    The slices are staged because two later steps must see the same cut points.
    """
    by = list(by)
    totals = df.groupBy(*by, value).agg(*[e.alias(n) for n, e in sums.items()])
    sliced = stage(
        totals.repartitionByRange(*by, value).withColumn("_slice", F.spark_partition_id())
    )
    earlier = (
        Window.partitionBy(*by, F.lit(0))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(n).alias(f"_o_{n}") for n in sums])
        .select(
            *by, "_slice",
            *[F.coalesce(F.sum(f"_o_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
            *[F.sum(f"_o_{n}").over(Window.partitionBy(*by, F.lit(0))).alias(f"{n}_all") for n in sums],
        )
    )
    within = (
        Window.partitionBy(*by, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = null_safe(sliced, offsets, by + ["_slice"], "inner")
    return joined.select(
        *by, value, *sums,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias(f"{n}_before")
            for n in sums
        ],
        *[f"{n}_all" for n in sums],
    )
