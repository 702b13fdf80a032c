"""Missing values and unread input are errors or are left out by name, never by accident."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_quantiles
from cohortlens.operators import diagnostics as D
from cohortlens.operators import groups as G
from cohortlens.operators import survey as V
from cohortlens.sources import io

PERSON = "id int, h int, c int, w double, y int"


def design(spark, rows, **options):
    return V.survey_design(spark.createDataFrame(rows, PERSON), "h", "c", "w", check=False, **options)


def test_missing_weight_is_an_error(spark):
    rows = [(i, 1, i % 3, 1.0 if i else None, i % 2) for i in range(6)]
    with pytest.raises(ValueError, match="1 rows have no weight"):
        V.survey_mean(design(spark, rows), ["y"])
    whole = V.survey_mean(design(spark, rows[1:]), ["y"]).first()
    assert whole["n"] == 5 and abs(whole["estimate"] - 0.6) < 1e-12


def test_split_cluster_is_an_error_unless_nested(spark):
    rows = [(i, i % 2, i % 3, 1.0, i % 2) for i in range(12)]
    with pytest.raises(ValueError, match="several strata"):
        V.survey_mean(design(spark, rows), ["y"])
    assert V.survey_mean(design(spark, rows, nest=True), ["y"]).first()["n"] == 12


def test_diagnostics_leave_out_missing_rows(spark):
    rows = [(float(i), i % 2, 0.3 + 0.004 * i, 0.1 * i) for i in range(100)]
    odd = [(None, 1, 0.5, 1.0)] * 20 + [(5.0, None, 0.5, None)] * 3 + [(5.0, 1, None, None)] * 2
    schema = "x double, y int, p double, pearson double"
    clean, both = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    trend = [tuple(r) for r in D.residual_trend(both, "x").orderBy("bin").collect()]
    assert [r[1] for r in trend] == [10] * 10
    seen = both.where(F.col("x").isNotNull())
    for f in (lambda d: D.goodness_of_fit(d, "y", "p", 2), lambda d: D.hosmer_lemeshow(d, "y", "p"), lambda d: D.performance(d, "y", "p", 2)):
        assert tuple(f(seen).first()) == pytest.approx(tuple(f(clean).first()))


def test_unread_area_line_is_an_error(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    feature = {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": square}}
    good = tmp_path / "good.json"
    good.write_text('{"type": "FeatureCollection", "features": [\n' + json.dumps(feature) + ",\n" + json.dumps(feature) + "\n]}\n\n")
    vertices, attributes = io.load_areas(spark, str(good), "id", "id int")
    assert (vertices.count(), attributes.count()) == (10, 2)
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(feature, indent=1))
    with pytest.raises(Exception, match="neither a feature"):
        io.load_areas(spark, str(bad), "id", "id int")[0].count()
    assert io.load_area_collection(spark, str(_collection(tmp_path, feature)), "id", "id int")[1].count() == 1


def _collection(tmp_path, feature):
    path = tmp_path / "whole.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}, indent=1))
    return path


def test_area_without_estimate_stays(spark):
    vertices = spark.createDataFrame(
        [(a, 0, 0, i, float(x), float(y)) for a in (1, 2) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])],
        "area_id int, part int, ring int, seq int, x double, y double",
    )
    attributes = spark.createDataFrame([(1, 0.5), (3, 0.7)], "area_id int, rate double")
    out = {r["properties"]["area_id"]: r for r in io.area_features(vertices, attributes).collect()}
    assert sorted(out) == [1, 2, 3]
    assert out[2]["properties"]["rate"] is None and out[3]["geometry"] is None and out[1]["geometry"] is not None


def test_quantiles_with_many_values_in_one_group(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    row = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], accuracy=1000).first()
    assert [round(v, 6) for v in row["q"]] == [0.0, 14999.75, 29999.5, 59999.0]
    plan = exact_quantiles(df, "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "_slice" in plan


def test_case_set_reads_its_input_once(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (4, 0, 0)], "ptid int, pm int, ref int")
    out = G.case_reference_set(df, "pm", F.col("ref") == 1)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 0), (2, 0, 1), (3, 0, 1)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
