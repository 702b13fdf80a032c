"""Contingency tables, shares and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortlens.functions.nulls import distinct_tuples, ratio
from cohortlens.functions.quantiles import exact_quantiles, running_totals
from cohortlens.functions.staging import distinct_levels, null_safe, stage


def share(value: Column, by: list[str]) -> Column:
    """Share of ``value`` in the total of its level of ``by``.

    Meant for result tables: the window holds counted levels, never rows.
    """
    return ratio(value, F.sum(value).over(Window.partitionBy(*by)))


def share_of_total(table: DataFrame, value: str, out: str) -> DataFrame:
    """Share of every row in the grand total, which is one number read from the staged table."""
    table = stage(table)
    total = table.agg(F.sum(value).cast("double")).first()[0]
    return table.withColumn(out, ratio(F.col(value), F.lit(total)))


def one_way(df: DataFrame, column: str) -> DataFrame:
    """Counts per level with null as a level, percent of all and percent of the non-null."""
    out = share_of_total(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "n", "percent")
    valid = out.where(F.col(column).isNotNull()).agg(F.sum("n")).first()[0]
    share_valid = F.when(F.col(column).isNotNull(), ratio(F.col("n"), F.lit(valid)))
    return out.select(column, "n", "percent", share_valid.alias("valid_percent"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts per non-null level with percent and running count and percent."""
    rows = df.where(F.col(column).isNotNull()).select(column)
    counted = running_totals(rows, column, {"n": F.count(F.lit(1))})
    out = share_of_total(counted, "n", "percent").withColumn("cum_n", F.col("n_before") + F.col("n"))
    unit = F.col("percent") * 100 / F.col("n")
    return out.select(
        column, "n", (F.col("percent") * 100).alias("percent"), "cum_n",
        (F.col("cum_n") * unit).alias("cum_percent"),
    )


def cross_table(
    df: DataFrame, columns: list[str], levels: dict[str, list] | None = None,
    include_null: bool = False, value: Column | None = None, out: str = "n",
) -> DataFrame:
    """Two- or three-way table in long form, zero-filled over all level combinations.

    Levels are those that occur, however many, or given ones.  ``value`` replaces the row count by a
    sum, for weighted tables.
    """
    levels = levels or {}
    counted = df.groupBy(*columns).agg(
        (F.count(F.lit(1)) if value is None else F.sum(value)).alias(out)
    )
    if not include_null:
        counted = counted.dropna(subset=columns)
    counted = stage(counted)
    grid = None
    for name in columns:
        found = counted.select(name).distinct()
        if levels.get(name):
            given = F.array(*[F.lit(v).cast(df.schema[name].dataType) for v in levels[name]])
            found = found.where(F.col(name).isNull()).union(df.sparkSession.range(1).select(F.explode(given).alias(name)))
        # every combination is a row of the result
        grid = found if grid is None else grid.crossJoin(found)
    filled = null_safe(grid, counted, columns)
    return filled.withColumn(out, F.coalesce(out, F.lit(0).cast(counted.schema[out].dataType)))


def wide_table(df: DataFrame, row: str, column: str, levels: list | None = None) -> DataFrame:
    """Two-way counts with one output column per level of ``column``."""
    levels = levels or distinct_levels(df, column)
    counts = [
        F.count_if(F.col(column) == F.lit(v)).alias(f"{column}_{v}") for v in levels
    ]
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(*counts)


def table_layer(table: DataFrame, column: str, level) -> DataFrame:
    """One layer of a three-way table."""
    return table.where(F.col(column) == F.lit(level)).drop(column)


def with_share(table: DataFrame, by: list[str], value: str = "n", out: str = "prop") -> DataFrame:
    """Row or column proportions of a long table; ``by`` empty gives shares of the grand total."""
    if not by:
        return share_of_total(table, value, out)
    return table.withColumn(out, share(F.col(value), by))


def percent_text(p: Column, digits: int = 1) -> Column:
    """Proportion as percent text, rounded half to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(p * 100, digits).cast("double"))


def counts_sorted(df: DataFrame, column: str) -> DataFrame:
    """Counts per level, largest first."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_last(column))


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.variable", "p.x")


def summary(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Minimum, quartiles, maximum, mean and null count of each column (per group)."""
    by = list(by)
    keys = by + ["variable"]
    long = _long(df, columns, by)
    x = F.col("_x")
    also = {
        "n_null": F.count_if(x.isNull()), "mean": F.avg(x), "sd": F.stddev_samp(x),
    }
    out = exact_quantiles(long, "x", [0, 0.25, 0.5, 0.75, 1], keys, also=also)
    names = ["min", "q1", "median", "q3", "max"]
    return out.select(
        *keys, "n", "n_null", "mean", "sd", *[F.col("q")[i].alias(v) for i, v in enumerate(names)]
    )


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Completeness, moments and quartiles of every numeric column, one row per column."""
    if columns is None:
        columns = [f.name for f in df.schema if f.dataType.simpleString() in
                   ("int", "bigint", "smallint", "float", "double")]
    out = summary(df, columns)
    return out.withColumn(
        "complete_rate", ratio(F.col("n"), F.col("n") + F.col("n_null"))
    )


def null_count(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def n_distinct(df: DataFrame, tuples: dict[str, list[str]]) -> DataFrame:
    """Distinct counts over tuples, null counting as a value; one output column per entry."""
    return df.agg(*[distinct_tuples(*cols).alias(name) for name, cols in tuples.items()])


def n_distinct_approx(df: DataFrame, tuples: dict[str, list[str]], rsd: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts, where an approximate answer is asked for."""
    return df.agg(
        *[F.approx_count_distinct(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}), rsd)
          .alias(n) for n, c in tuples.items()]
    )


def households_per_cluster(df: DataFrame, cluster: str, household: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(distinct_tuples(*household).alias("n_households"))


def positives_by_area(df: DataFrame, area: str, flags: list[str]) -> DataFrame:
    """Positive and negative counts of each flag per area, with their total."""
    aggs = []
    for f in flags:
        pos, neg = F.count_if(F.col(f) == 1), F.count_if(F.col(f) == 0)
        aggs += [neg.alias(f"{f}_neg"), pos.alias(f"{f}_pos"), (neg + pos).alias(f"{f}_n")]
    return df.groupBy(area).agg(*aggs)
