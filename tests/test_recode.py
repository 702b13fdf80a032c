"""Missing-value rules, recodes, tables and joins on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.functions.nulls import if_else, ratio, strict_sum, to_number
from cohortlens.operators import filters as flt
from cohortlens.operators import groups as G
from cohortlens.operators import recode as P
from cohortlens.operators import tables as T


def column(df, name="out", order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def ints(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, x {kind}")


def test_flag_is_strict_and_null_rules_differ(spark):
    df = ints(spark, [549.9, 550.0, 550.1, None], "double")
    assert column(df.withColumn("out", P.flag_above(F.col("x"), 550))) == [0, 0, 1, 0]
    assert column(df.withColumn("out", P.flag_above_keep_null(F.col("x"), 550))) == [0, 0, 1, None]


def test_background_filter_keeps_missing(spark):
    df = ints(spark, [500.0, 500.1, None], "double")
    assert column(flt.drop_high_background(df, "x"), "id") == [0, 2]


def test_if_else_keeps_null(spark):
    df = ints(spark, [1, 2, None])
    assert column(df.withColumn("out", if_else(F.col("x") == 2, F.lit(0), F.lit(9)))) == [9, 0, None]


def test_ratio_and_strict_sum_and_cast(spark):
    df = ints(spark, [0, 2])
    assert column(df.withColumn("out", ratio(F.lit(1), F.col("x")))) == [None, 0.5]
    got = ints(spark, [1, None]).agg(strict_sum(F.col("x")).alias("s"), F.sum("x").alias("t")).first()
    assert (got["s"], got["t"]) == (None, 1)
    assert column(ints(spark, ["7", "abc"], "string").withColumn("out", to_number(F.col("x")))) == [7, None]


def test_age_groups(spark):
    df = ints(spark, [0, 2, 3, 4, 5, 9, 10, 13, 14, 15, None])
    assert column(P.age_group3(df, "x", "out")) == [1, 1, 1, 1, 2, 2, 3, 3, 3, None, None]
    assert column(P.age_group7(df, "x", "out")) == [1, 1, 2, 2, 3, 5, 5, 7, 7, None, None]


def test_ranges_leave_gaps_null(spark):
    from cohortlens.functions.constants import ROOF_RANGES

    df = ints(spark, [13, 14, 20, 21, 23, 31, 38, 96, 97, None])
    got = column(df.withColumn("out", P.recode_ranges(F.col("x"), ROOF_RANGES)))
    assert got == [0, None, None, 2, None, 1, None, 9, None, None]


def test_nets_and_area_key(spark):
    df = spark.createDataFrame(
        [(1, 2, None, 4), (2, 1, 3, 5), (3, None, 2, 4), (4, 1, 2, 0), (5, 8, None, 3)],
        "id int, a1q119 int, a1q120 int, ahmember int",
    )
    got = P.net_counts(df).orderBy("id").collect()
    assert [r["num_nets"] for r in got] == [0, 3, None, 2, None]
    assert [r["net1_8"] for r in got] == [0, 1, None, None, None]
    keys = spark.createDataFrame([(1, 35, 9), (2, 35, 10), (3, None, 1)], "id int, ahstate int, ahlga int")
    assert column(P.area_key(keys, out="out")) == [3509, 3510, None]


def test_species_unknown_counts_as_zero(spark):
    df = ints(spark, ["2(Pf Pm)", "3 (Pf PM PO)", "unknown", None, "1"], "string")
    got = P.species_flags(df, "x").orderBy("id").collect()
    assert [r["pcr_pm"] for r in got] == [1, 1, 0, 0, 0]
    assert [r["pcr_pm_pf"] for r in got] == [1, 0, 0, 0, 0]
    assert [r["pcr_species"] for r in got][3] == "0"
    assert [r["pcr_pfmono"] for r in got] == [0, 0, 0, 0, 1]


def test_percent_text_rounds_half_even(spark):
    df = ints(spark, [0.1225, 0.1235, 1.0], "double")
    assert column(df.withColumn("out", T.percent_text(F.col("x")))) == [
        "12.2%", "12.4%", "100.0%",
    ]


def test_cross_table_fills_zero_and_null_level(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 3)], "a int, b int")
    assert {tuple(r) for r in T.cross_table(df, ["a", "b"]).collect()} == {
        (1, 1, 1), (1, 3, 0), (2, 1, 0), (2, 3, 1),
    }
    assert (1, None, 1) in {tuple(r) for r in T.cross_table(df, ["a", "b"], include_null=True).collect()}


def test_tuple_count_and_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "a int, b int")
    assert T.n_distinct(df, {"n": ["a", "b"]}).first()["n"] == 2
    left = spark.createDataFrame([(None, 1), (5, 2)], "k int, v int")
    right = spark.createDataFrame([(None, "x"), (5, "y")], "k int, w string")
    assert {r["w"] for r in G.left_join(left, right, "k").collect()} == {"x", "y"}


def test_first_per_key_and_case_set(spark):
    df = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"), (2, None, "c"), (2, 0, "d"), (3, None, "e")], "ptid int, y int, z string"
    )
    got = {r["ptid"]: r["z"] for r in G.first_per_key(df, ["ptid"], [("y", "desc")]).collect()}
    assert got == {1: "b", 2: "d", 3: "e"}
    cases = G.case_reference_set(df, "y", F.col("z").isin("a", "c", "e"))
    assert {(r["ptid"], r["y"]) for r in cases.collect()} == {(1, 1), (2, 0), (3, 0)}


def test_normalised_weights(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 6.0), (2, 1.0), (2, None)], "c int, w double")
    got = G.normalise_weights(df, "c", "w").groupBy("c").agg(F.sum("s_ab_wt").alias("s")).collect()
    assert {r["c"]: r["s"] for r in got} == {1: pytest.approx(2.0), 2: None}


def test_merge_prefixes_and_repeated_key_is_an_error(spark):
    a = spark.createDataFrame([(1, 0.5)], "k int, ci double")
    assert G.merge_tables({"x": a, "y": a}, "k").columns == ["k", "x_ci", "y_ci"]
    with pytest.raises(Exception, match="not unique"):
        G.left_join(a, a.union(a), "k").collect()


def test_labels(spark):
    df = P.label_columns(ints(spark, [1, 2, 3]), {"x": "Sex"}, {"x": {1: "male", 2: "female"}})
    assert df.schema["x"].metadata["label"] == "Sex"
    assert column(P.decode_labels(df, "x", out="out")) == ["male", "female", None]


def test_sources(spark, tmp_path):
    from cohortlens.sources import io
    from cohortlens.sources.schema import LAB

    df = spark.createDataFrame([("7", "Pm", None, "Zones", "x")], "PTID string, species_present string, "
                               "missing_samples string, selection_criteria string, cluster string")
    io.write_table(df, str(tmp_path / "lab"), "csv")
    row = io.load_table(spark, str(tmp_path / "lab"), LAB, "csv").first()
    assert (row["ptid"], row["cluster"]) == (7, None)
    with pytest.raises(ValueError):
        io.load_table(spark, str(tmp_path / "lab"), StructType.fromDDL("zz int"), "csv")
    assert io.column_profile(df).count() == 5


def test_area_files(spark, tmp_path):
    import json

    from cohortlens.operators.spatial import centroids
    from cohortlens.sources import io

    shell = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"id": 1, "n": 9},
         "geometry": {"type": "Polygon", "coordinates": [shell, hole]}},
        {"type": "Feature", "properties": {"id": 2, "n": 3},
         "geometry": {"type": "MultiPolygon", "coordinates": [[shell], [[[x + 10, y] for x, y in shell]]]}},
    ]
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    v, a = io.load_area_collection(spark, str(path), "id", "id int, n int")
    got = {r["area_id"]: r for r in centroids(v).collect()}
    assert got[1]["area"] == pytest.approx(12)
    assert got[1]["cx"] == pytest.approx((16 * 2 - 4 * 1) / 12)
    assert got[2]["cx"] == pytest.approx(7)
    io.write_areas(v, a, str(tmp_path / "out"))
    v2, a2 = io.load_areas(spark, str(tmp_path / "out"), "area_id", "area_id int, n int")
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect()))
    assert {tuple(r) for r in a2.collect()} == {(1, 9), (2, 3)}
