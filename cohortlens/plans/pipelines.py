"""Pipelines of the study: cleaning, covariates, laboratory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.staging import stage
from cohortlens.operators import filters as flt
from cohortlens.operators import groups as G
from cohortlens.operators import recode as P
from cohortlens.plans import survey_view as view


def clean_persons(df: DataFrame, drop_background: bool = True) -> DataFrame:
    """Exclude high background, classify all signals and group ages."""
    if drop_background:
        df = flt.drop_high_background(df)
    df = df.withColumnRenamed("hrp2_1", "hrp2_a")
    return P.age_group3(P.antigen_flags(P.antibody_flags(df)))


def person_covariates(df: DataFrame) -> DataFrame:
    """Model covariates of every surveyed person; net coverage uses all members of a cluster."""
    return G.net_coverage(P.net_counts(P.household_recodes(df)))


def lab_with_covariates(spark: SparkSession, sf_dir: str, samples: DataFrame) -> DataFrame:
    """The laboratory ``samples`` that are not missing, with species flags and survey covariates."""
    covariates = person_covariates(view.persons(spark, sf_dir)).select(
        "ptid", "age", "gender", "urban", "wealthquintile", "a1qnumber", "netcover_avg",
        "netcover_ind", "ahstate",
    )
    lab = flt.missing(samples, "missing_samples")
    return P.age_group3(G.left_join(P.species_flags(lab), covariates, "ptid"))


def model_persons(df: DataFrame) -> DataFrame:
    """Persons with model covariates and an outcome that varies by cluster.

    ``clustered`` shifts the age-dependent positivity by a hash of the cluster.
    """
    out = P.age_group3(person_covariates(df))
    effect = (F.pmod(F.xxhash64("varunit"), F.lit(1000)) / 1000.0 - 0.5) * 3.0
    chance = 1 / (1 + F.exp(-(-1.5 + 0.15 * F.col("age") + effect)))
    draw = F.pmod(F.xxhash64("ptid", F.lit(7)), F.lit(100_000)) / 100_000.0
    return out.withColumn("clustered", F.when(draw < chance, 1).otherwise(0))


ANTIGEN_POS = ["hrp2_pos", "paldo_pos", "pldh_pos", "pvldh_pos"]


def flagged_persons(persons: DataFrame) -> DataFrame:
    return P.antigen_flags(persons.withColumnRenamed("hrp2_1", "hrp2_a"))


def _all_negative() -> Column:
    negative = F.lit(True)
    for flag in ANTIGEN_POS:
        negative = negative & (F.col(flag) == 0)
    return negative


def infection_case_set(persons: DataFrame, lab: DataFrame, outcome: str) -> DataFrame:
    """Infected persons and persons negative on all four antigens, one row each.

    A person in both groups counts as a case; a reference person without a laboratory result
    counts as not infected.
    """
    joined = G.left_join(flagged_persons(persons), P.species_flags(lab).select("ptid", outcome), "ptid")
    return G.case_reference_set(joined, outcome, _all_negative())


def infection_case_sets(
    flagged: DataFrame, lab: DataFrame, outcomes: list[str], columns: list[str]
) -> dict[str, DataFrame]:
    """``infection_case_set`` of every outcome with ``columns`` only, from one staged join of persons and samples.

    ``flagged`` has the antigen flags.  Of a person's rows the first is kept by all columns there are, so ``columns``
    must tell rows of a person apart in their order.
    """
    persons = flagged.select("ptid", *columns, *ANTIGEN_POS)
    joined = stage(G.left_join(persons, P.species_flags(lab).select("ptid", *outcomes), "ptid"))
    return {
        o: G.case_reference_set(joined.drop(*[x for x in outcomes if x != o]), o, _all_negative()) for o in outcomes
    }
