"""Model queries reach every row and every covariate."""

import pytest

from cohortlens.plans import registry
from cohortlens.plans import survey_view as view
from cohortlens.plans.pipelines import lab_with_covariates

SF = "/root/testdata/sf0.001"
TERMS = ["agegrp", "gender", "wealthquintile", "urban", "netcover_ind", "netcover_avg"]


@pytest.fixture(scope="module")
def lab(spark):
    """Samples of all orders that are not missing and have every covariate."""
    df = lab_with_covariates(spark, SF, view.all_samples(spark, SF)).dropna(subset=TERMS)
    samples = view.all_samples(spark, SF).where("missing_samples IS NULL").select("ptid")
    assert df.join(samples, "ptid", "left_anti").count() == 0
    return df.select("pcr_species", "pcr_pf", "pcr_pm", "pcr_po").toPandas()


def test_firth_reads_all_orders(spark, lab):
    n = {r["n"] for r in registry.firth(spark, SF).collect()}
    assert n == {int(lab.pcr_po.notna().sum())}


def test_case_models_read_all_orders(spark, lab):
    got = {r["comparison"]: (r["n"], r["events"]) for r in registry.case_models(spark, SF).collect()}
    pf_alone = (lab.pcr_pf == 1) & (lab.pcr_pm == 0) & (lab.pcr_po == 0)
    none = lab.pcr_species == "0"
    want = {}
    for species in ("pm", "po", "pf"):
        cases = lab[f"pcr_{species}"] == 1
        if species != "pf":
            want[f"{species}_vs_pf"] = (int((cases | pf_alone).sum()), int(cases.sum()))
        want[f"{species}_vs_negative"] = (int((cases | none).sum()), int(cases.sum()))
    assert got == want


def test_bivariate_sweep_fits_every_covariate(spark, monkeypatch):
    asked = []

    def sweep(df, models, cluster, household=None):
        for key, outcome, terms in models:
            column = getattr(terms[0], "column", terms[0])
            assert df.where(f"{column} IS NOT NULL AND {outcome} IS NOT NULL").limit(1).count() == 1
            asked.append(key)
        return []

    monkeypatch.setattr(registry.X, "fit_mixed_models", sweep)
    covariates = ["ahmember", "livestock", "roof_mat", "wall_mat", "aircon", "electric", "water_source"]
    registry._bivariate(spark, SF)
    assert sorted(asked) == sorted(f"{o}~{c}" for o in [*registry.ANTIGENS, "clustered"] for c in covariates)
