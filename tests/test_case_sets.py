"""Case sets of several outcomes from one narrow join keep the rows of the whole one."""

from pyspark.sql import functions as F

from cohortlens.plans import pipelines as L
from cohortlens.plans import registry
from cohortlens.plans import survey_view as view

SF = "/root/testdata/sf0.001"


def test_case_sets_equal_the_single_one_with_repeated_persons(spark):
    persons = view.persons(spark, SF)
    again = persons.where("ptid % 3 = 0").withColumns({"varunit": F.col("varunit") + F.col("ptid") % 2, "gender": 3 - F.col("gender")})
    # the third row of a person differs after the cluster alone
    third = persons.where("ptid % 4 = 0").withColumn("hhwgt", F.col("hhwgt") + 1).withColumn("wealthquintile", F.lit(5))
    persons = L.model_persons(persons.unionByName(again).unionByName(third)).localCheckpoint()
    lab = view.lab_samples(spark, SF)
    sets = L.infection_case_sets(L.flagged_persons(persons), lab, ["pcr_pm", "pcr_po"], registry.CASE_COLUMNS)
    for outcome, got in sets.items():
        want = L.infection_case_set(persons, lab, outcome)
        assert "pmmsp1" in want.columns and not {"pmmsp1", "paldo"} & set(got.columns)
        rows = [sorted(map(tuple, df.select(sorted(got.columns)).collect()), key=str) for df in (got, want)]
        assert len(rows[0]) > 100 and rows[0] == rows[1]


def test_sweep_joins_persons_once(spark, monkeypatch):
    """Both outcomes read one staged join, whose rows carry no signals."""
    seen = []
    plain = registry.M.model_sweep

    def sweep(df, outcomes, terms):
        seen.append(df)
        return plain(df, outcomes, terms)

    monkeypatch.setattr(registry.M, "model_sweep", sweep)
    assert registry.infection_sweep(spark, SF).count() == 54
    assert len(seen) == 2 and len({tuple(sorted(df.inputFiles())) for df in seen}) == 1
    assert not any("lineitem" in f for df in seen for f in df.inputFiles())
