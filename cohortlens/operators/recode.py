"""Row-wise recodes: stateless projections that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import constants as K
from cohortlens.functions.nulls import if_else, ratio, to_number
from cohortlens.functions.staging import null_safe


# ---- column expressions -------------------------------------------------------------------


def flag_above(x: Column, cutoff: float) -> Column:
    """1 above the cut-off, else 0; a missing signal counts as negative."""
    return F.when(x > cutoff, 1).otherwise(0)


def flag_above_keep_null(x: Column, cutoff: float) -> Column:
    """1 above the cut-off, else 0; a missing signal stays missing."""
    return if_else(x > cutoff, 1, 0)


def bin_by_breaks(x: Column, breaks: list, closed_end: bool = False) -> Column:
    """1-based bin of left-closed intervals; outside every bin the result is null."""
    last = len(breaks) - 2
    parts = []
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        upper = x <= hi if (closed_end and i == last) else x < hi
        parts.append(((x >= lo) & upper, F.lit(i + 1)))
    return _chain(parts)


def recode(x: Column, mapping: dict) -> Column:
    """Map listed values; everything else, null included, becomes null."""
    return _chain([(x == F.lit(k), F.lit(v)) for k, v in mapping.items()])


def recode_ranges(x: Column, ranges: list) -> Column:
    """Map ``(low, high, low closed, high closed, code)`` ranges; gaps become null."""
    parts = []
    for lo, hi, lo_closed, hi_closed, code in ranges:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= lo if lo_closed else x > lo)
        if hi is not None:
            cond = cond & (x <= hi if hi_closed else x < hi)
        parts.append((cond, F.lit(code)))
    return _chain(parts)


def _chain(parts: list) -> Column:
    (cond, value), *rest = parts
    return reduce(lambda acc, p: acc.when(*p), rest, F.when(cond, value))


def floor_signal(x: Column, floor: float = 1.0) -> Column:
    """Non-positive signals are lifted to ``floor`` for a log axis."""
    return F.when(x <= 0, F.lit(floor)).otherwise(x)


# ---- operators ----------------------------------------------------------------------------


def log_signals(df: DataFrame, signals=tuple(K.IGG_CUTOFFS), prefix: str = "log") -> DataFrame:
    """Natural logs; null where the signal is missing or not positive."""
    return df.withColumns({f"{prefix}{s}": F.ln(s) for s in signals})


def antibody_flags(df: DataFrame, cutoffs: dict = K.IGG_CUTOFFS) -> DataFrame:
    return df.withColumns(
        {K.FLAG_NAMES.get(s, f"{s}pos"): flag_above(F.col(s), c) for s, c in cutoffs.items()}
    )


def antigen_flags(df: DataFrame, cutoffs: dict = K.ANTIGEN_CUTOFFS) -> DataFrame:
    return df.withColumns(
        {
            K.FLAG_NAMES.get(s, f"{s}_pos"): flag_above_keep_null(F.col(s), c)
            for s, c in cutoffs.items()
        }
    )


def age_group3(df: DataFrame, age: str = "age", out: str = "agegrp") -> DataFrame:
    """Under 5, 5-9 and 10-14 years; a missing age stays missing."""
    return df.withColumn(out, bin_by_breaks(F.col(age), K.AGE3_BREAKS))


def age_group7(df: DataFrame, age: str = "age", out: str = "agegrp7") -> DataFrame:
    """Under 3, then two-year groups up to 14 included."""
    x = F.col(age)
    first = F.when(x < K.AGE7_BREAKS[1], 1)
    rest = bin_by_breaks(x, K.AGE7_BREAKS[1:], closed_end=True) + 1
    return df.withColumn(out, F.coalesce(first, rest))


def band_midpoints(
    df: DataFrame, band: str, breaks: list = tuple(K.AGE7_BREAKS), out: str = "midpoint"
) -> DataFrame:
    """Plotting position of a band number: the middle of its break pair."""
    mids = {i + 1: (lo + hi) / 2 for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]))}
    return df.withColumn(out, recode(F.col(band), mids))


def household_recodes(df: DataFrame) -> DataFrame:
    """Yes/no answers, sex, residence, water source and building materials as model codes."""
    out = {
        "net_own": recode(F.col("a1q119"), K.YES_NO),
        "livestock": recode(F.col("a1q115"), K.YES_NO),
        "aircon": recode(F.col("a1q105n"), K.YES_NO),
        "electric": recode(F.col("a1q105a"), K.YES_NO),
        "water_source": recode(F.col("a1q101a"), K.WATER_SOURCE),
        "gender": recode(F.col("gender"), K.YES_NO),
        "urban": recode(F.col("ahtype"), K.YES_NO),
        "roof_mat": recode_ranges(F.col("a1q108"), K.ROOF_RANGES),
        "wall_mat": recode_ranges(F.col("a1q109"), K.WALL_RANGES),
    }
    return df.withColumns(out)


def net_counts(
    df: DataFrame, owns: str = "a1q119", nets: str = "a1q120", members: str = "ahmember",
    adequacy: float = K.NET_ADEQUACY,
) -> DataFrame:
    """Nets of the household (0 when it owns none), nets per member, adequacy flag."""
    counted = df.withColumn("num_nets", if_else(F.col(owns) == 2, F.lit(0), F.col(nets)))
    per_member = counted.withColumn("netratio", ratio(F.col("num_nets"), F.col(members)))
    return per_member.withColumn("net1_8", if_else(F.col("netratio") >= adequacy, 1, 0))


def area_key(df: DataFrame, state: str = "ahstate", lga: str = "ahlga", out: str = "lga"):
    """State code followed by the two-digit area code, as a number."""
    code = F.col(lga)
    text = if_else(code < 10, F.concat(F.lit("0"), code.cast("string")), code.cast("string"))
    return df.withColumn(out, to_number(F.concat(F.col(state).cast("string"), text), "int"))


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts in which unreadable text becomes null."""
    return df.withColumns({c: to_number(F.col(c), t) for c, t in types.items()})


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def species_flags(df: DataFrame, species: str = "species_present") -> DataFrame:
    """Decode the species text to Pf/Pm/Po flags and infection-composition flags.

    Unknown and missing texts decode to null and then count as 0.
    """
    text = F.col(species)
    flags = {
        name: recode(text, {s: f[i] for s, f in K.SPECIES_FLAGS.items()})
        for i, name in enumerate(("pcr_pf", "pcr_pm", "pcr_po"))
    }
    code = F.coalesce(text, F.lit("0"))
    has = K.SPECIES_FLAGS
    compositions = {
        "pcr_pfmono": code == "1",
        "pcr_pm_pf": code.isin([s for s, (_, pm, po) in has.items() if pm and not po]),
        "pcr_po_pf": code.isin([s for s, (_, pm, po) in has.items() if po and not pm]),
    }
    decoded = fill_zero(df.withColumns(flags), list(flags))
    return decoded.withColumn("pcr_species", code).withColumns(
        {k: c.cast("int") for k, c in compositions.items()}
    )


def floor_signals(df: DataFrame, signals: list[str], floor: float = 1.0) -> DataFrame:
    return df.withColumns({s: floor_signal(F.col(s), floor) for s in signals})


def selection_code(df: DataFrame, column: str = "selection_criteria", out: str = "selection_cri"):
    return df.withColumn(out, recode(F.col(column), K.SELECTION_CODES))


def label_columns(df: DataFrame, labels: dict[str, str], values: dict[str, dict] | None = None):
    """Attach variable and value labels as column metadata."""
    for name in {*labels, *(values or {})}:
        meta = {"label": labels.get(name, name)}
        if values and name in values:
            meta["values"] = {str(k): v for k, v in values[name].items()}
        df = df.withMetadata(name, meta)
    return df


def decode_labels(df: DataFrame, column: str, labels: DataFrame | None = None, out: str | None = None):
    """Replace codes by their text, from a ``(code, label)`` table or the column's value labels."""
    out = out or f"{column}_label"
    if labels is None:
        values = df.schema[column].metadata["values"]
        return df.withColumn(out, recode(F.col(column).cast("string"), values))
    table = labels.select(F.col("code").alias(column), F.col("label").alias(out))
    return null_safe(df, table, [column])
