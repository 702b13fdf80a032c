"""Group statistics on every row, first-per-key, unions, joins and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.nulls import distinct_tuples, strict_sum
from cohortlens.functions.staging import attach, null_safe

def _n():
    return F.count(F.lit(1))


# ---- group statistics on every row ----------------------------------------------------------


def add_group_size(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return attach(df, df.groupBy(*keys).agg(_n().alias(out)), keys)


def add_group_sum(df: DataFrame, keys: list[str], column: str, out: str = "n") -> DataFrame:
    """Group sum on every row; missing values add nothing."""
    total = F.coalesce(F.sum(column), F.lit(0))
    return attach(df, df.groupBy(*keys).agg(total.alias(out)), keys)


def net_coverage(df: DataFrame, cluster: str = "varunit", net: str = "net1_8") -> DataFrame:
    """Cluster size, adequately covered members, cluster coverage and the individual's deviation."""
    stats = df.groupBy(cluster).agg(
        _n().alias("n_clust"), F.coalesce(F.sum(net), F.lit(0)).alias("n_net")
    )
    stats = stats.withColumn(
        "netcover_avg", F.col("n_net").cast("double") / F.col("n_clust").cast("double")
    )
    out = attach(df, stats, [cluster])
    return out.withColumn("netcover_ind", F.col(net) - F.col("netcover_avg"))


def normalise_weights(
    df: DataFrame, cluster: str = "varunit", weight: str = "ab_wt", out: str = "s_ab_wt"
) -> DataFrame:
    """Scale weights to sum to the group size in each cluster.

    One missing weight makes the weights of its whole cluster missing.
    """
    stats = df.groupBy(cluster).agg((_n() / strict_sum(F.col(weight))).alias("weight_mult"))
    return attach(df, stats, [cluster]).withColumn(out, F.col(weight) * F.col("weight_mult"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the number of copies."""
    counts = df.groupBy(*keys).agg(_n().alias("dupe_count")).where("dupe_count > 1")
    return attach(df, counts, keys, "inner")


# ---- first per key, unions --------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """One whole row per key: the first in ``order``, ties broken by all remaining columns.

    ``order`` holds ``(column, "asc" | "desc")`` with nulls last; "desc" needs a number.  It is a
    minimum over structs, so rows of a hot key are reduced before the shuffle.
    """
    rank = []
    for i, (name, direction) in enumerate(order):
        col = F.col(name)
        rank += [
            col.isNull().alias(f"_n{i}"),
            (-col if direction == "desc" else col).alias(f"_v{i}"),
        ]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min(F.struct(*rank, *[F.col(c) for c in rest])).alias("_best")
    )
    picked = {c: F.col("_best").getField(c) for c in rest}
    return best.select(*[picked[c].alias(c) if c in picked else c for c in df.columns])


def case_reference_set(
    df: DataFrame, outcome: str, reference: Column, key: str = "ptid"
) -> DataFrame:
    """Cases and reference rows, one per person; a person in both counts as a case."""
    kept = first_per_key(df.where(reference | (F.col(outcome) == 1)), [key], [(outcome, "desc")])
    return kept.fillna(0, subset=[outcome])


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def sorted_desc(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.desc_nulls_last(c) for c in columns])


# ---- joins ------------------------------------------------------------------------------------


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Attach the columns of ``right``; a repeated key on the right is an error.

    Keys are counted in the shuffle that the join needs anyway, so the check costs no scan of its own.
    """
    columns = [c for c in right.columns if c != key]
    counted = right.groupBy(key).agg(
        F.count(F.lit(1)).alias("_times"), F.first(F.struct(F.lit(0).alias("_"), *columns)).alias("_row")
    )
    unique = F.when(F.col("_times") == 1, True).otherwise(
        F.raise_error(F.concat(F.lit(f"{key} is not unique on the right side: "), F.col(key).cast("string"))).cast("boolean")
    )
    once = counted.where(unique).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    return null_safe(left, once, [key])


def membership(df: DataFrame, other: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    """1 where the key occurs in the other table, else 0."""
    keys = other.select(key).distinct().withColumn(out, F.lit(1))
    return null_safe(df, keys, [key]).fillna(0, subset=[out])


def merge_tables(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of result tables on one key; other columns are prefixed by the table's name."""
    named = [
        t.withColumnsRenamed({c: f"{name}_{c}" for c in t.columns if c != key})
        for name, t in tables.items()
    ]
    return reduce(lambda a, b: null_safe(a, b, [key], "inner"), named)


# ---- quality checks -----------------------------------------------------------------------------


def identical_columns(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Whether two columns agree on every row, null agreeing with null; one output per pair."""
    return df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(n) for n, (a, b) in pairs.items()])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_n().alias("n")).where("n > 1")


def keys_not_nested(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Values of ``inner`` that occur under more than one value of ``outer``."""
    return df.groupBy(inner).agg(distinct_tuples(outer).alias("n_outer")).where("n_outer > 1")


def nesting_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Distinct clusters, distinct (stratum, cluster) pairs and whether they agree."""
    counts = df.agg(
        distinct_tuples(inner).alias("n_inner"), distinct_tuples(outer, inner).alias("n_pairs")
    )
    return counts.withColumn("nested", F.col("n_inner") == F.col("n_pairs"))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules in one pass; an undecided rule counts as broken."""
    one = df.agg(
        *[F.count_if(~F.coalesce(r, F.lit(False))).alias(name) for name, r in rules.items()]
    )
    items = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    )
    return one.select(F.explode(items).alias("r")).select("r.rule", "r.violations")
