"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import constants as K
from cohortlens.functions.quantiles import running_totals
from cohortlens.functions.staging import null_safe, stage, staging_dir
from cohortlens.operators import catalytic as C
from cohortlens.operators import diagnostics as D
from cohortlens.operators import filters as flt
from cohortlens.operators import groups as G
from cohortlens.operators import linear as L
from cohortlens.operators import logistic as M
from cohortlens.operators import mixed as X
from cohortlens.operators import mixture as N
from cohortlens.operators import recode as P
from cohortlens.operators import smooth as S
from cohortlens.operators import spatial as A
from cohortlens.operators import survey as V
from cohortlens.operators import tables as T
from cohortlens.plans import survey_view as view
from cohortlens.plans.pipelines import (
    clean_persons,
    flagged_persons,
    infection_case_set,
    infection_case_sets,
    lab_with_covariates,
    model_persons,
)
from cohortlens.sources import io

Query = Callable[[SparkSession, str], DataFrame]
MSP1 = ["pmmsp1", "pomsp1", "pvmsp1", "pfmsp1"]
MSP1_POS = [f"{a}pos" for a in MSP1]
SIGNALS = [*K.IGG_CUTOFFS, "gst"]
AREA_FLAGS = ["pmpos", "popos"]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else f.name
            for f in df.schema
        ]
    )


def floats(df: DataFrame) -> DataFrame:
    """Doubles in single precision: comparable across engines without decimal ties."""
    return df.select(
        *[
            F.col(f.name).cast("float").alias(f.name) if f.dataType.simpleString() == "double" else f.name
            for f in df.schema
        ]
    )


def design(df: DataFrame) -> V.Design:
    return V.survey_design(df, "varstrat", "varunit", "ab_wt", rescale=True, check=False)  # its estimates check


# ---- cleaning and recodes ---------------------------------------------------------------------


@query
def clean_antibody(spark, sf_dir):
    df = P.age_group7(P.log_signals(clean_persons(view.persons(spark, sf_dir))))
    df = df.withColumns({s: F.col(s).cast("float") for s in [*K.IGG_CUTOFFS, "hrp2_a"]})
    return rounded(df.select(*K.KEEP_COLUMNS, "agegrp7", *[f"log{s}" for s in K.IGG_CUTOFFS]))


@query
def clean_antigen(spark, sf_dir):
    df = clean_persons(view.persons(spark, sf_dir), drop_background=False)
    flags = ["hrp2_pos", "paldo_pos", "pldh_pos", "pvldh_pos"]
    return flt.complete_cases(df, flags).select("ptid", "varunit", "agegrp", *flags)


@query
def recode_household(spark, sf_dir):
    df = P.net_counts(P.household_recodes(view.persons(spark, sf_dir)))
    return rounded(
        df.select(
            "ptid", "net_own", "livestock", "aircon", "electric", "water_source", "gender", "urban",
            "roof_mat", "wall_mat", "num_nets", "netratio", "net1_8",
        )
    )


@query
def area_key(spark, sf_dir):
    df = P.cast_columns(view.persons(spark, sf_dir), {"ahstate": "string"})
    return P.area_key(df).select("ptid", "ahstate", "ahlga", "lga")


@query
def age_midpoints(spark, sf_dir):
    df = P.band_midpoints(P.age_group7(view.persons(spark, sf_dir)), "agegrp7")
    return df.groupBy("agegrp7", "midpoint").agg(F.count(F.lit(1)).alias("n"))


@query
def species_flags(spark, sf_dir):
    df = P.selection_code(P.species_flags(view.all_samples(spark, sf_dir)))
    return df.select(
        "ptid", "pcr_species", "pcr_pf", "pcr_pm", "pcr_po", "pcr_pfmono", "pcr_pm_pf", "pcr_po_pf",
        "selection_cri",
    )


@query
def floored_signals(spark, sf_dir):
    df = P.floor_signals(view.persons(spark, sf_dir), MSP1)
    return rounded(df.select("ptid", *MSP1))


@query
def decoded_labels(spark, sf_dir):
    df = P.label_columns(
        view.persons(spark, sf_dir).select("ptid", "gender", "ahzone"),
        {"gender": "Sex", "ahzone": "Zone"}, {"gender": {1: "male", 2: "female"}},
    )
    named = P.decode_labels(df, "gender")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    labels = region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return P.decode_labels(named, "ahzone", labels, "zone_label")


# ---- filters ------------------------------------------------------------------------------------


@query
def inspect_signals(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    low = (F.col("pomsp1") < 0.5) | (F.col("gst") > K.GST_LIMIT) | F.col("gst").isNull()
    return rounded(flt.inspect(df, low, ["ptid", "varunit", "gst", "pomsp1"]))


@query
def missing_signals(spark, sf_dir):
    return flt.missing_counts(view.persons(spark, sf_dir), "gst")


@query
def size_filter(spark, sf_dir):
    return flt.groups_by_size(view.persons(spark, sf_dir), ["varunit"], above=4)


@query
def large_cluster_rows(spark, sf_dir):
    df = flt.rows_in_large_groups(view.persons(spark, sf_dir), ["varunit"], above=12)
    return df.select("ptid", "varunit")


@query
def case_vs_reference(spark, sf_dir):
    lab = P.species_flags(view.all_samples(spark, sf_dir))
    sets = {
        "pm_vs_pf": flt.is_case_or_pf_mono("pcr_pm"), "po_vs_pf": flt.is_case_or_pf_mono("pcr_po"),
        "pm_vs_negative": flt.is_case_or_negative("pcr_pm"),
        "po_vs_negative": flt.is_case_or_negative("pcr_po"),
        "pf_vs_negative": flt.is_case_or_negative("pcr_pf"),
    }
    rows = flt.in_sets(lab, sets, "comparison")
    return rows.select("comparison", "ptid", "pcr_species", "pcr_pf", "pcr_pm", "pcr_po")


@query
def case_reference_set(spark, sf_dir):
    out = infection_case_set(view.persons(spark, sf_dir), view.lab_samples(spark, sf_dir), "pcr_pm")
    return out.select("ptid", "varunit", "pcr_pm", "hrp2_pos", "paldo_pos", "pldh_pos", "pvldh_pos")


@query
def four_antigen_negative(spark, sf_dir):
    df = clean_persons(view.persons(spark, sf_dir), drop_background=False)
    flags = ["hrp2_pos", "paldo_pos", "pldh_pos", "pvldh_pos"]
    return flt.all_negative(df, flags).select("ptid", "varunit")


# ---- joins ----------------------------------------------------------------------------------------


@query
def pcr_join(spark, sf_dir):
    df = lab_with_covariates(spark, sf_dir, view.lab_samples(spark, sf_dir))
    return rounded(
        df.select(
            "ptid", "cluster", "pcr_species", "pcr_pm", "pcr_po", "agegrp", "gender", "urban",
            "wealthquintile", "netcover_avg", "netcover_ind",
        )
    )


@query
def membership(spark, sf_dir):
    persons = view.persons(spark, sf_dir).select("ptid", "ahstate")
    lab = view.lab_samples(spark, sf_dir)
    flagged = G.membership(persons, lab, "ptid", "in_lab")
    return flagged.groupBy("ahstate", "in_lab").agg(F.count(F.lit(1)).alias("n"))


@query
def state_merge(spark, sf_dir):
    df = view.antibody_persons(spark, sf_dir)
    est = V.survey_mean(design(df), MSP1_POS, ["ahstate"], ("ci",))
    est = stage(est)
    tables = {
        o: est.where(F.col("outcome") == o).select("ahstate", "estimate", "ci_low", "ci_high")
        for o in MSP1_POS
    }
    infected = T.positives_by_area(df, "ahstate", ["pmpos", "popos"])
    return rounded(G.merge_tables({**tables, "serology": infected}, "ahstate"))


# ---- tables ---------------------------------------------------------------------------------------


@query
def clusters_by_size(spark, sf_dir):
    """O1: clusters by falling size, the place of each from running totals instead of one window."""
    sizes = view.persons(spark, sf_dir).groupBy("varunit").agg(F.count(F.lit(1)).alias("n"))
    keyed = sizes.withColumn("place", F.struct((-F.col("n")).alias("n"), (-F.col("varunit")).alias("u")))
    ranked = running_totals(keyed, "place", {"c": F.count(F.lit(1))})
    out = ranked.select(
        (-F.col("place.u")).alias("varunit"), (-F.col("place.n")).alias("n"),
        (F.col("c_before") + 1).alias("rank"),
    )
    return G.sorted_desc(out, "n", "varunit")


@query
def largest_clusters(spark, sf_dir):
    """O5: the first rows of a sorted table, a top-k report."""
    sizes = view.persons(spark, sf_dir).groupBy("varunit").agg(F.count(F.lit(1)).alias("n"))
    return G.head(G.sorted_desc(sizes, "n", "varunit"), 10)


@query
def table_round_trip(spark, sf_dir):
    """S1, S3 and S5: the cleaned persons written, read back with a schema and summed up by state."""
    kept = view.persons(spark, sf_dir).select("ptid", "varunit", "ahstate", "age")
    path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    io.write_table(kept, path, "csv", ["ptid", "varunit", "ahstate", "age"])
    back = io.load_table(spark, path, kept.schema, "csv")
    return back.groupBy("ahstate").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ptid").alias("ids"), F.count("age").alias("n_age")
    )


@query
def areas_round_trip(spark, sf_dir):
    """S2 and S4: areas written as features, read back and summed up."""
    vertices = view.area_vertices(spark, sf_dir)
    names = vertices.select("area_id").distinct().withColumn("label", F.concat(F.lit("area "), F.col("area_id").cast("string")))
    path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    io.write_areas(vertices, names, path)
    back, attributes = io.load_areas(spark, path, "area_id", "area_id bigint, label string")
    shape = back.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("points"), F.max("part").alias("last_part"), F.max("ring").alias("last_ring"),
        *[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum))],
    )
    return null_safe(attributes, shape, ["area_id"])


@query
def tab1(spark, sf_dir):
    return rounded(T.one_way(view.persons(spark, sf_dir), "a1q119"))


@query
def tab_freq(spark, sf_dir):
    return rounded(T.frequency(view.persons(spark, sf_dir), "a1q120"))


@query
def tab_sorted(spark, sf_dir):
    return T.counts_sorted(view.persons(spark, sf_dir), "varunit")


@query
def tab2(spark, sf_dir):
    df = P.age_group3(view.persons(spark, sf_dir))
    return T.cross_table(df, ["a1q119", "wealthquintile"], include_null=True)


@query
def tab2_wide(spark, sf_dir):
    return T.wide_table(view.persons(spark, sf_dir), "ahstate", "wealthquintile")


@query
def tab3(spark, sf_dir):
    lab = P.selection_code(P.species_flags(view.all_samples(spark, sf_dir)))
    persons = view.persons(spark, sf_dir).select("ptid", "ahstate")
    table = T.cross_table(
        G.left_join(lab, persons, "ptid"), ["ahstate", "selection_cri", "pcr_pm"]
    )
    return T.table_layer(table, "pcr_pm", 1)


@query
def tab_pct(spark, sf_dir):
    df = P.age_group3(view.persons(spark, sf_dir))
    table = T.cross_table(df, ["agegrp", "pmpos"])
    out = T.with_share(T.with_share(table, ["agegrp"], out="row_share"), ["pmpos"], out="col_share")
    return rounded(out.withColumn("row_percent", T.percent_text(F.col("row_share"))))


@query
def serology_by_age_group(spark, sf_dir):
    df = P.age_group7(view.antibody_persons(spark, sf_dir))
    return rounded(T.with_share(T.cross_table(df, ["pvmsp1pos", "agegrp7"]), ["agegrp7"], out="share"))


@query
def summary(spark, sf_dir):
    df = T.summary(view.persons(spark, sf_dir), ["gst", "pomsp1", "ahmember", "a1q120"], ["ahzone"])
    return floats(df)


@query
def profile(spark, sf_dir):
    return floats(T.profile(view.persons(spark, sf_dir), ["age", "ab_wt", *SIGNALS, "a1q119"]))


@query
def null_counts(spark, sf_dir):
    return T.null_count(view.persons(spark, sf_dir), ["a1q119", "a1q120", "gst", "age"])


@query
def n_distinct(spark, sf_dir):
    tuples = {"psu": ["varunit"], "pairs": ["varstrat", "varunit"], "answers": ["a1q119", "a1q120"]}
    return T.n_distinct(view.persons(spark, sf_dir), tuples)


@query
def hh_per_cluster(spark, sf_dir):
    return T.households_per_cluster(view.persons(spark, sf_dir), "varunit", ["hh_id"])


@query
def infection_by_state(spark, sf_dir):
    lab = P.species_flags(view.all_samples(spark, sf_dir))
    joined = G.left_join(lab, view.persons(spark, sf_dir).select("ptid", "ahstate"), "ptid")
    return T.positives_by_area(joined, "ahstate", ["pcr_pm", "pcr_po"])


# ---- groups -----------------------------------------------------------------------------------------


@query
def net_coverage(spark, sf_dir):
    df = G.net_coverage(P.net_counts(view.persons(spark, sf_dir)))
    return rounded(df.select("ptid", "varunit", "n_clust", "n_net", "netcover_avg", "netcover_ind"))


@query
def weights_normalised(spark, sf_dir):
    df = G.normalise_weights(view.persons(spark, sf_dir))
    return rounded(df.select("ptid", "varunit", "ab_wt", "s_ab_wt"))


@query
def group_size(spark, sf_dir):
    df = view.persons(spark, sf_dir).select("ptid", "hh_id", "ahmember")
    sized = G.add_group_size(df, ["hh_id"], "n_household")
    return G.add_group_sum(sized, ["hh_id"], "ahmember", "members")


@query
def dupes(spark, sf_dir):
    return G.duplicates(view.persons(spark, sf_dir).select("hh_id", "ptid"), ["hh_id"])


@query
def first_per_key(spark, sf_dir):
    df = view.persons(spark, sf_dir).select("hh_id", "ptid", "age", "varunit", "pmpos")
    return G.first_per_key(df, ["hh_id"], [("age", "desc"), ("ptid", "asc")])


@query
def distinct_keys(spark, sf_dir):
    return view.persons(spark, sf_dir).select("varstrat", "varunit", "a1q119").distinct()


# ---- quality ----------------------------------------------------------------------------------------


@query
def quality_rules(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    rules = {
        "age_in_range": F.col("age").between(0, 14), "gender_coded": F.col("gender").isin(1, 2),
        "gst_present": F.col("gst").isNotNull(), "net_answer_known": F.col("a1q119").isin(1, 2),
    }
    return G.rule_violations(df, rules)


@query
def quality_keys(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    same = G.identical_columns(df, {"state_is_stratum": ("ahstate", "varstrat"),
                                    "zone_is_stratum": ("ahzone", "varstrat")})
    nest = G.nesting_counts(df, "varstrat", "varunit")
    repeated = G.repeated_keys(df, ["ptid"]).agg(F.count(F.lit(1)).alias("repeated_ptid"))
    split = G.keys_not_nested(df, "ahstate", "ahzone").agg(F.count(F.lit(1)).alias("split_states"))
    out = same
    for t in (nest, repeated, split):
        out = null_safe(out.withColumn("_k", F.lit(1)), t.withColumn("_k", F.lit(1)), ["_k"]).drop("_k")
    return out


# ---- survey estimates ---------------------------------------------------------------------------------


@query
def design_check(spark, sf_dir):
    return V.design_summary(design(view.persons(spark, sf_dir)))


@query
def svy_prev_by_state(spark, sf_dir):
    df = view.antibody_persons(spark, sf_dir)
    return rounded(V.survey_mean(design(df), ["pmmsp1pos"], ["ahstate"]).drop("outcome"))


@query
def svy_total(spark, sf_dir):
    return rounded(V.survey_total(design(view.antibody_persons(spark, sf_dir)), MSP1_POS), 4)


@query
def svy_mean(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    return rounded(V.survey_mean(design(df), ["age", "pomsp1"], vartype=("se", "ci", "cv")), 5)


@query
def svy_levels(spark, sf_dir):
    df = P.age_group3(view.persons(spark, sf_dir))
    return rounded(V.survey_levels(design(df), "agegrp"))


@query
def svy_table_2way(spark, sf_dir):
    df = view.antibody_persons(spark, sf_dir)
    return rounded(V.survey_table(design(df), ["ahstate", "pfmsp1pos"]), 5)


@query
def svy_table_1way(spark, sf_dir):
    df = P.net_counts(view.persons(spark, sf_dir))
    return rounded(V.survey_table(design(df), ["net1_8"]), 5)


@query
def svy_rse_by_area(spark, sf_dir):
    df = P.area_key(view.antibody_persons(spark, sf_dir))
    out = V.survey_mean(design(df), MSP1_POS, ["lga"], ("se", "rse"))
    return rounded(out, 5)


@query
def svy_quantiles(spark, sf_dir):
    out = V.survey_quantiles(design(view.persons(spark, sf_dir)), "age")
    return out.withColumn("se", F.round("se", 6))


@query
def svy_signal_quantiles(spark, sf_dir):
    out = V.survey_quantiles(design(view.persons(spark, sf_dir)), "pvmsp1")
    return rounded(out)


@query
def svy_sweep(spark, sf_dir):
    df = P.area_key(view.antibody_persons(spark, sf_dir))
    return rounded(V.survey_sweep(design(df), MSP1_POS, ["ahzone", "ahstate", "lga"]), 5)


@query
def svy_lonely_psu(spark, sf_dir):
    lone = F.when(F.col("varunit") % 500 == 0, 1000 + F.col("varunit")).otherwise(F.col("varstrat"))
    df = view.persons(spark, sf_dir).withColumn("h", lone)
    d = V.survey_design(df, "h", "varunit", "ab_wt", rescale=True, check=False)  # its estimates check
    mean = V.survey_mean(d, ["pmpos"], ["gender"], ("se",)).withColumn("stat", F.lit("mean"))
    total = V.survey_total(d, ["pmpos"], ["gender"], ("se",)).withColumn("stat", F.lit("total"))
    return rounded(mean.unionByName(total).drop("outcome"), 5)


@query
def svy_area_counts(spark, sf_dir):
    df = P.area_key(view.antibody_persons(spark, sf_dir))
    return rounded(V.area_counts(design(df), "lga", MSP1_POS), 5)


# ---- regression, correlation --------------------------------------------------------------------------


@query
def ols(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    return rounded(L.ols(df, "pfmsp1", "pvmsp1", ["ahzone"], p_values=False), 4)


@query
def ols_tests(spark, sf_dir):
    return L.ols(view.persons(spark, sf_dir), "pfmsp1", "pvmsp1")


@query
def regression_line(spark, sf_dir):
    out = L.regression_line(view.persons(spark, sf_dir), "pfmsp1", "pvmsp1", ["ahzone"], points=20)
    return rounded(out, 4)


@query
def corr_test(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    return rounded(L.correlation_test(df, "pmmsp1", "pomsp1", ["ahzone"], p_values=False), 4)


# ---- areas --------------------------------------------------------------------------------------------


def _area_counts(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    return V.area_counts(design(df), "varunit", AREA_FLAGS).withColumnRenamed("varunit", "area_id")


@query
def queen_nb(spark, sf_dir):
    return A.queen_neighbours(view.area_vertices(spark, sf_dir))


@query
def nb_summary(spark, sf_dir):
    v = view.area_vertices(spark, sf_dir)
    return rounded(A.neighbour_summary(v, A.queen_neighbours(v)))


@query
def nb_histogram(spark, sf_dir):
    v = view.area_vertices(spark, sf_dir)
    return A.link_histogram(v, A.queen_neighbours(v))


@query
def centroid(spark, sf_dir):
    return rounded(A.centroids(view.area_vertices(spark, sf_dir)))


@query
def eb_local(spark, sf_dir):
    edges = A.queen_neighbours(view.area_vertices(spark, sf_dir))
    counts = [f"n_{f}" for f in AREA_FLAGS]
    return rounded(A.eb_local(_area_counts(spark, sf_dir), edges, counts))


@query
def smoothed_areas(spark, sf_dir):
    """Estimates attached to their polygons as GeoJSON features."""
    from cohortlens.sources.io import area_features

    v = view.area_vertices(spark, sf_dir)
    est = A.eb_local(_area_counts(spark, sf_dir), A.queen_neighbours(v), [f"n_{f}" for f in AREA_FLAGS])
    wide = est.groupBy("area_id").agg(
        *[F.max(F.when(F.col("outcome") == f"n_{f}", F.col("est"))).alias(f"eb_{f}") for f in AREA_FLAGS]
    )
    features = area_features(v, wide)
    return rounded(
        features.select(
            "properties.area_id", "properties.eb_pmpos", "properties.eb_popos",
            F.size("geometry.coordinates").alias("parts"),
            F.size(F.col("geometry.coordinates")[0][0]).alias("points"),
        )
    )


# ---- seroconversion -----------------------------------------------------------------------------------


STRATA = ["gender", "ahtype", "wealthquintile", "ahstate"]


def _counts(spark, sf_dir):
    return C.serostatus_counts(view.persons(spark, sf_dir), AREA_FLAGS, STRATA)


def _zone_counts(spark, sf_dir):
    return C.serostatus_counts(view.persons(spark, sf_dir), AREA_FLAGS, ["ahzone"])


@query
def age_bins_wilson(spark, sf_dir):
    return rounded(C.wilson_age_bins(view.persons(spark, sf_dir), "pmpos", ["gender"]))


@query
def serostatus_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def sero_loglik(spark, sf_dir):
    return rounded(C.log_likelihood(_counts(spark, sf_dir), 0.12, 0.08), 4)


@query
def sero_grid_posterior(spark, sf_dir):
    m = C.posterior_marginals_one_pass(_zone_counts(spark, sf_dir), cells=60, lowest=1e-3)
    return rounded(C.posterior_summary(m), 5)


@query
def sero_density(spark, sf_dir):
    m = C.posterior_marginals_one_pass(_zone_counts(spark, sf_dir), cells=60, lowest=1e-3)
    return rounded(C.posterior_density(m), 5)


@query
def sero_curve(spark, sf_dir):
    m = C.posterior_marginals_one_pass(_zone_counts(spark, sf_dir), cells=60, lowest=1e-3)
    return rounded(C.posterior_curve(C.posterior_summary(m)), 5)


@query
def sero_posterior(spark, sf_dir):
    """Both rates by zone on the grid of two passes."""
    return rounded(C.posterior_summary(C.posterior_marginals(_zone_counts(spark, sf_dir))), 5)


@query
def sero_density_fine(spark, sf_dir):
    """Mass and region of every cell of the grid of two passes."""
    m = stage(C.posterior_marginals(_zone_counts(spark, sf_dir)))
    keys = [*C.GROUP, "parameter", "cell"]
    out = null_safe(C.posterior_density(m).drop("density"), m.select(*keys, "mass"), keys, "inner")
    return out.withColumns({"x": F.round("x", 6), "mass": F.round("mass", 6)})


@query
def sero_curve_fine(spark, sf_dir):
    summary = C.posterior_summary(C.posterior_marginals(_zone_counts(spark, sf_dir)))
    return rounded(C.posterior_curve(summary), 5)


@query
def seroconversion(spark, sf_dir):
    return C.seroconversion(view.persons(spark, sf_dir), AREA_FLAGS, STRATA)


@query
def sero_draws(spark, sf_dir):
    return C.posterior_draws(_zone_counts(spark, sf_dir))


@query
def sero_draw_summary(spark, sf_dir):
    return C.draw_summary(stage(C.posterior_draws(_zone_counts(spark, sf_dir))))


@query
def sero_draw_band(spark, sf_dir):
    return C.draw_band(stage(C.posterior_draws(_zone_counts(spark, sf_dir), draws=2000)))


@query
def signal_density(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    return rounded(C.kernel_density(df, "pvmsp1", ["ahzone"]))


def _rates_and_infection(spark, sf_dir):
    """Per species the seroconversion rate and the infection prevalence of every state."""
    rates = stage(C.seroconversion(view.persons(spark, sf_dir), ["pmpos", "popos"], ["ahstate"]))
    infection = infection_by_state(spark, sf_dir)
    parts = []
    for species in ("pm", "po"):
        prev = infection.select(
            "ahstate", F.try_divide(f"pcr_{species}_pos", f"pcr_{species}_n").alias("prevalence")
        )
        joined = C.seroconversion_vs_infection(rates, prev, "ahstate", f"{species}pos", "ahstate")
        parts.append(joined.select("prevalence", "scr", F.lit(species).alias("species")))
    return parts[0].unionByName(parts[1])


@query
def scr_vs_infection(spark, sf_dir):
    return L.ols(_rates_and_infection(spark, sf_dir), "prevalence", "scr", ["species"])


@query
def scr_infection_line(spark, sf_dir):
    """The fitted line and its confidence band over the range of prevalence."""
    return L.regression_line(_rates_and_infection(spark, sf_dir), "prevalence", "scr", ["species"])


# ---- smoothing and plot data ----------------------------------------------------------------------------


@query
def boxplot_stats(spark, sf_dir):
    return rounded(S.boxplot_stats(view.persons(spark, sf_dir), "pomsp1", ["ahzone", "gender"]))


@query
def hist_sizes(spark, sf_dir):
    sizes = view.persons(spark, sf_dir).groupBy("varunit").agg(F.count(F.lit(1)).alias("n_cluster"))
    return S.histogram(sizes, "n_cluster")


@query
def scatter_bins(spark, sf_dir):
    return S.binned_scatter(view.persons(spark, sf_dir), "pfmsp1", "pvmsp1", 100.0, 20.0)


@query
def age_profile(spark, sf_dir):
    df = P.household_recodes(view.persons(spark, sf_dir))
    return rounded(S.prevalence_by_age(df, AREA_FLAGS, ["urban", "aircon"]))


@query
def loess_age(spark, sf_dir):
    df = S.prevalence_by_age(view.persons(spark, sf_dir), AREA_FLAGS, ["gender"])
    at = F.transform(F.sequence(F.lit(0), F.lit(140)), lambda i: i / 10.0)
    return rounded(S.loess(df, "age", "prevalence", ["gender", "outcome"], at, with_se=False), 5)


@query
def loess_age_se(spark, sf_dir):
    df = S.prevalence_by_age(view.persons(spark, sf_dir), AREA_FLAGS, ["gender"])
    at = F.transform(F.sequence(F.lit(0), F.lit(140)), lambda i: i / 10.0)
    return S.loess(df, "age", "prevalence", ["gender", "outcome"], at)


# ---- models -----------------------------------------------------------------------------------------


def _terms():
    return [
        M.factor("agegrp", (1, 2, 3)), "gender", M.factor("wealthquintile", (1, 2, 3, 4, 5)), "urban",
        "netcover_ind", "netcover_avg",
    ]


def _scored(spark, sf_dir):
    """Persons with a given fitted probability, for diagnostics that need no fit."""
    eta = -1.4 + 0.11 * F.col("age") - 0.05 * F.col("ahmember")
    df = view.persons(spark, sf_dir).select("ptid", "age", "ahmember", "pmpos")
    p = 1 / (1 + F.exp(-eta))
    return df.withColumn("p_hat", p).withColumn(
        "pearson", (F.col("pmpos") - F.col("p_hat")) / F.sqrt(F.col("p_hat") * (1 - F.col("p_hat")))
    )


@query
def gof(spark, sf_dir):
    return rounded(D.goodness_of_fit(_scored(spark, sf_dir), "pmpos", "p_hat", 3, p_values=False), 4)


@query
def hosmer(spark, sf_dir):
    return rounded(D.hosmer_lemeshow(_scored(spark, sf_dir), "pmpos", "p_hat", p_values=False), 4)


@query
def binned_resid(spark, sf_dir):
    return rounded(D.binned_residuals(_scored(spark, sf_dir), "pmpos", "p_hat").drop("bin"))


@query
def binned_resid_share(spark, sf_dir):
    return rounded(D.share_inside(D.binned_residuals(_scored(spark, sf_dir), "pmpos", "p_hat")))


@query
def model_performance(spark, sf_dir):
    return rounded(D.performance(_scored(spark, sf_dir), "pmpos", "p_hat", 3), 4)


@query
def residual_trend(spark, sf_dir):
    return rounded(D.residual_trend(_scored(spark, sf_dir), "age").drop("bin"))


@query
def separation_levels(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return M.level_separation(df, "popos", ["agegrp", "wealthquintile", "gender", "age"])


@query
def separation_ranges(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return rounded(M.range_separation(df, "popos", ["netcover_avg", "netcover_ind", "age"]))


@query
def separation_fit(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return M.fit_separation(df, M.fit_logistic(df, "pmpos", _terms()))


@query
def logistic(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return M.odds_ratios(df, [M.fit_logistic(df, "pmpos", _terms())])


@query
def firth(spark, sf_dir):
    df = lab_with_covariates(spark, sf_dir, view.all_samples(spark, sf_dir))
    return M.odds_ratios(df, [M.fit_logistic(df, "pcr_po", _terms(), kind="firth")])


@query
def model_sweep(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return M.odds_ratios(df, M.model_sweep(df, AREA_FLAGS, _terms()))


#: Covariates of the case models after what tells two rows of a person apart, in the order of the person table.
CASE_COLUMNS = [
    "varstrat", "varunit", "hhwgt", "gender", "wealthquintile", "urban", "netcover_avg", "netcover_ind", "agegrp",
]


@query
def infection_sweep(spark, sf_dir):
    # flags before the covariates, so that no shuffle but the one by person carries signals
    persons = model_persons(flagged_persons(view.persons(spark, sf_dir)))
    sets = infection_case_sets(persons, view.lab_samples(spark, sf_dir), ["pcr_pm", "pcr_po"], CASE_COLUMNS)
    sweeps = [M.odds_ratios(df, M.model_sweep(df, [outcome], _terms())) for outcome, df in sets.items()]
    return sweeps[0].unionByName(sweeps[1])


def _case_fits(spark, sf_dir):
    """(comparison, rows, adjusted bias-reduced model): both species against Pf alone, all three against negatives."""
    lab = stage(lab_with_covariates(spark, sf_dir, view.all_samples(spark, sf_dir)))
    sets = {
        "pm_vs_pf": flt.case_or_pf_mono(lab, "pcr_pm"), "po_vs_pf": flt.case_or_pf_mono(lab, "pcr_po"),
        "pm_vs_negative": flt.case_or_negative(lab, "pcr_pm"),
        "po_vs_negative": flt.case_or_negative(lab, "pcr_po"),
        "pf_vs_negative": flt.case_or_negative(lab, "pcr_pf"),
    }
    for name, df in sets.items():
        yield name, df, M.fit_models(df, [M.Model(name, f"pcr_{name[:2]}", _terms(), "firth")])[0]


@query
def case_models(spark, sf_dir):
    tables = []
    for name, df, model in _case_fits(spark, sf_dir):
        model.model_id = model.outcome
        tables.append(M.odds_ratios(df, [model]).withColumn("comparison", F.lit(name)))
    return reduce(DataFrame.unionByName, tables)


def _case_patterns(spark, sf_dir):
    fits = list(_case_fits(spark, sf_dir))
    rows = reduce(DataFrame.union, [M.fitted_patterns(df, [m]) for _, df, m in fits])
    return rows, [m for *_, m in fits]


@query
def firth_gof(spark, sf_dir):
    rows, models = _case_patterns(spark, sf_dir)
    return D.goodness_of_fit(rows, "y", "p_hat", D.parameters_of(models), by=["model_id"], n="n")


@query
def firth_binned(spark, sf_dir):
    rows, _ = _case_patterns(spark, sf_dir)
    return D.binned_residuals(rows, "y", "p_hat", by=["model_id"], n="n")


@query
def firth_collinearity(spark, sf_dir):
    fits = list(_case_fits(spark, sf_dir))
    return D.collinearity(fits[0][1], *[m for *_, m in fits])


def _saturated(spark, sf_dir, kind):
    df = model_persons(view.persons(spark, sf_dir))
    fitted = M.fit_logistic(df, "pmpos", [M.factor("wealthquintile", (1, 2, 3, 4, 5))], kind=kind)
    kept = ["term", "estimate", "se", "ci_low", "ci_high", "odds_ratio", "or_low", "or_high"]
    return rounded(M.odds_ratios(df, [fitted]).select(*kept, "n", "events"), 4)


@query
def logistic_slope(spark, sf_dir):
    """One numeric covariate, by likelihood and bias-reduced."""
    df = view.persons(spark, sf_dir)
    models = [M.Model(kind, "pmpos", ["age"], kind) for kind in ("ml", "firth")]
    out = M.odds_ratios(df, M.fit_models(df, models))
    return out.select(
        F.col("model_id").alias("kind"), "term", *[F.round(c, 5).alias(c) for c in ("estimate", "se", "odds_ratio")], "n", "events"
    )


@query
def glmm_laplace(spark, sf_dir):
    """Laplace likelihood and gradient of a mixed model at fixed parameters: the pass without the search."""
    df = view.persons(spark, sf_dir)
    out = X.laplace(df, "pmpos", ["age"], "varunit", [-1.0, 0.15], [0.7, 0.0])
    return out.withColumn("value", F.round("value", 4))


@query
def logistic_saturated(spark, sf_dir):
    return _saturated(spark, sf_dir, "ml")


@query
def firth_saturated(spark, sf_dir):
    return _saturated(spark, sf_dir, "firth")


@query
def model_scores(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    scored = M.score(df, M.fit_logistic(df, "pmpos", _terms()))
    return scored.select("ptid", "pmpos", "p_hat", "hat", "resid", "pearson", "deviance")


@query
def model_collinearity(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return D.collinearity(df, M.fit_logistic(df, "pmpos", _terms()))


@query
def model_curvature(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return D.curvature_tests(df, M.fit_logistic(df, "pmpos", _terms()))


@query
def model_outlier(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return D.outlier_test(M.score(df, M.fit_logistic(df, "pmpos", _terms())), "ptid")


@query
def model_tests(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    model = M.fit_logistic(df, "pmpos", _terms())
    scored = stage(M.score(df, model).select("pmpos", "p_hat"))
    fit = D.goodness_of_fit(scored, "pmpos", "p_hat", len(model.beta))
    hl = D.hosmer_lemeshow(scored, "pmpos", "p_hat")
    return fit.select(
        F.lit("deviance").alias("test"), F.col("deviance").alias("statistic"),
        F.col("df").cast("long").alias("df"), F.col("p_deviance").alias("p"),
    ).unionByName(
        fit.select(
            F.lit("pearson").alias("test"), F.col("pearson").alias("statistic"),
            F.col("df").cast("long").alias("df"), F.col("p_pearson").alias("p"),
        )
    ).unionByName(
        hl.select(
            F.lit("hosmer_lemeshow").alias("test"), F.col("chisq").alias("statistic"),
            F.col("df").cast("long").alias("df"), "p",
        )
    )


N_SIGNALS = ["ama1", "csp", "glurp0", "hrp2", "lsa1", "pfmsp1", "pmmsp1", "pomsp1", "pvmsp1"]


@query
def mixture2(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    k = {s: 6 if s in ("ama1", "pfmsp1") else 2 for s in N_SIGNALS}
    return N.mixture_table(df, N.fit_mixtures(df, k))


#: Components from which ``mixture_em`` takes its plain steps: weight, mean and variance.
EM_START = [(0.5, 4.0, 1.0), (0.5, 6.0, 1.0)]
EM_STEPS = 6


@query
def mixture_em(spark, sf_dir):
    """Plain EM steps of two components from fixed starts: the pass itself, without the search around it."""
    df = view.persons(spark, sf_dir)
    w, mean, variance = (np.array(x) for x in zip(*EM_START))
    start = {s: N.Mixture(s, w, mean, variance) for s in N_SIGNALS}
    fits = N.fit_mixtures(df, dict.fromkeys(N_SIGNALS, 2), start=start, em_steps=EM_STEPS)
    table = N.mixture_table(df, fits)
    return table.select(
        "signal", "component", *[F.round(c, 6).alias(c) for c in ("weight", "mean", "variance")],
        F.round("minus2ll", 2).alias("minus2ll"),
    )


@query
def mixture_density(spark, sf_dir):
    df = view.persons(spark, sf_dir)
    k = {s: 6 if s in ("ama1", "pfmsp1") else 2 for s in N_SIGNALS}
    return N.mixture_density(df, N.fit_mixtures(df, k))


@query
def glmm(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return X.mixed_odds_ratios(df, [X.fit_mixed(df, "clustered", _terms(), "varunit")])


@query
def glmm_nested(spark, sf_dir):
    df = model_persons(view.persons(spark, sf_dir))
    return X.mixed_odds_ratios(df, [X.fit_mixed(df, "clustered", _terms(), "varunit", "a1qnumber")])


ANTIGENS = ["pmpos", "popos", "pvmsp1pos"]


def _sweep(spark, sf_dir):
    """Per antigen the six one-covariate mixed models and the adjusted one, all in the same passes."""
    df = P.antibody_flags(model_persons(view.persons(spark, sf_dir)))
    return df, X.mixed_sweep(df, ANTIGENS, _terms(), "varunit", adjusted=True)


@query
def glmm_sweep(spark, sf_dir):
    return X.mixed_odds_ratios(*_sweep(spark, sf_dir))


@query
def glmm_gof(spark, sf_dir):
    df, models = _sweep(spark, sf_dir)
    size = D.parameters_of([m.fixed for m in models], {m.fixed.model_id: 1 + m.nested for m in models})
    return D.goodness_of_fit(X.fitted_rows(models), "y", "p_hat", size, by=["model_id"], n="n")


@query
def glmm_binned(spark, sf_dir):
    df, models = _sweep(spark, sf_dir)
    return D.binned_residuals(X.fitted_rows(models), "y", "p_hat", by=["model_id"], n="n")


@query
def glmm_collinearity(spark, sf_dir):
    df, models = _sweep(spark, sf_dir)
    return D.collinearity(df, *[m.fixed for m in models if m.fixed.model_id.endswith("adjusted")])


def _bivariate(spark, sf_dir):
    df = P.antibody_flags(model_persons(view.persons(spark, sf_dir)))
    materials = [M.factor(c) for c in ("roof_mat", "wall_mat", "water_source")]
    covariates = ["ahmember", "livestock", "aircon", "electric", *materials]
    return df, X.mixed_sweep(df, [*ANTIGENS, "clustered"], covariates, "varunit")


@query
def glmm_bivariate(spark, sf_dir):
    return X.mixed_odds_ratios(*_bivariate(spark, sf_dir))


@query
def glmm_performance(spark, sf_dir):
    return X.mixed_performance(*_bivariate(spark, sf_dir))
