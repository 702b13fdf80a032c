"""Row selection rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import constants as K
from cohortlens.functions.staging import attach


def drop_high_background(df: DataFrame, column: str = "gst", limit: float = K.GST_LIMIT):
    """Drop rows above the limit; a missing control value is kept."""
    return df.where((F.col(column) <= limit) | F.col(column).isNull())


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def inspect(df: DataFrame, cond: Column, columns: list[str]) -> DataFrame:
    """Rows that meet an exploratory condition, reduced to the columns to look at."""
    return df.where(cond).select(*columns)


def is_case_or_pf_mono(outcome: str) -> Column:
    return (F.col(outcome) == 1) | (F.col("pcr_pfmono") == 1)


def is_case_or_negative(outcome: str) -> Column:
    return (F.col(outcome) == 1) | (F.col("pcr_species") == F.lit("0"))


def case_or_pf_mono(df: DataFrame, outcome: str) -> DataFrame:
    """Cases of ``outcome`` against infections with Pf alone."""
    return df.where(is_case_or_pf_mono(outcome))


def case_or_negative(df: DataFrame, outcome: str) -> DataFrame:
    """Cases of ``outcome`` against samples without any species."""
    return df.where(is_case_or_negative(outcome))


def in_sets(df: DataFrame, sets: dict[str, Column], out: str) -> DataFrame:
    """Every row once for each named condition that it meets, from one scan."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sets.items()]))
    return df.withColumn(out, F.explode(names))


def missing_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows with and without a value: (side, n_missing), from one scan."""
    missing = F.count_if(F.col(column).isNull())
    sides = [
        F.struct(F.lit("missing").alias("side"), missing.alias("n_missing")),
        F.struct(F.lit("present").alias("side"), F.count(column).alias("n_missing")),
    ]
    return df.agg(F.array(*sides).alias("s")).select(F.inline("s"))


def all_negative(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(f) == 0 for f in flags]))


def groups_by_size(df: DataFrame, keys: list[str], above: int | None = None, below: int | None = None):
    """Groups with more than ``above`` or fewer than ``below`` rows, with their size."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if above is not None:
        out = out.where(F.col("n") > above)
    if below is not None:
        out = out.where(F.col("n") < below)
    return out


def rows_in_large_groups(df: DataFrame, keys: list[str], above: int) -> DataFrame:
    """Rows whose group has more than ``above`` rows."""
    return attach(df, groups_by_size(df, keys, above=above).drop("n"), keys, "inner")
