"""Loading and writing of survey, laboratory and area tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.schema import check_columns


def load_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read a Parquet or CSV table; with a schema, names are checked and types are cast.

    CSV cells that do not parse become null, as in a spreadsheet import.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = spark.read.csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt}")
    return check_columns(df, schema) if schema else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", columns: list[str] | None = None):
    """Write a result as Parquet or CSV, optionally reduced to a fixed column list."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


# Lines of a collection other than its features: brackets, and the members that may stand beside them.
_COLLECTION_LINE = (
    r'^\s*[\[\]{},\s]*("type"\s*:\s*"FeatureCollection"|"name"\s*:\s*"[^"]*"|"crs"\s*:\s*\{.*\}|"features"\s*:|[\[\]{},\s])*$'
)
_RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def load_areas(spark: SparkSession, path: str, id_property: str, properties: str):
    """GeoJSON features as ``(vertices, attributes)``.

    One feature per line, with or without the lines of a collection around them; Polygon and
    MultiPolygon.  Any other line that is not blank is an error: files whose features span lines
    are read by ``load_area_collection``.  ``properties`` is the DDL of the wanted attributes, the
    identifier among them.
    """
    feature = (
        f"struct<type:string,properties:struct<{properties}>,"
        "geometry:struct<type:string,coordinates:string>>"
    )
    text = spark.read.text(path, wholetext=False)
    f = F.from_json("value", feature)
    around = F.col("value").rlike(_COLLECTION_LINE)
    problem = F.raise_error(F.concat(F.lit("neither a feature nor part of a collection: "), F.left("value", F.lit(80))))
    is_feature = F.when(F.coalesce(f["type"] == "Feature", F.lit(False)), True).otherwise(
        F.when(around, False).otherwise(problem.cast("boolean"))
    )
    return _split_areas(text.where(is_feature).select(f.alias("f")), id_property)


def load_area_collection(spark: SparkSession, path: str, id_property: str, properties: str):
    """The same for files that each hold one FeatureCollection."""
    feature = (
        f"struct<type:string,properties:struct<{properties}>,"
        "geometry:struct<type:string,coordinates:string>>"
    )
    schema = f"type string, features array<{feature}>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    return _split_areas(df.select(F.explode("features").alias("f")), id_property)


def _split_areas(features: DataFrame, id_property: str):
    attributes = features.select("f.properties.*").withColumnRenamed(id_property, "area_id")
    shape = features.select(
        F.col(f"f.properties.{id_property}").alias("area_id"),
        F.when(
            F.col("f.geometry.type") == "MultiPolygon",
            F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(_RING))),
        )
        .otherwise(F.array(F.from_json("f.geometry.coordinates", T.ArrayType(_RING))))
        .alias("parts"),
    )
    vertices = (
        shape.select("area_id", F.posexplode("parts").alias("part", "rings"))
        .select("area_id", "part", F.posexplode("rings").alias("ring", "points"))
        .select("area_id", "part", "ring", F.posexplode("points").alias("seq", "point"))
        .select(
            "area_id", "part", "ring", "seq",
            F.col("point")[0].alias("x"), F.col("point")[1].alias("y"),
        )
    )
    return vertices, attributes


def area_features(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """Polygons with their attributes, one GeoJSON feature per row.

    A polygon without attributes keeps null properties, and attributes without a polygon a null
    geometry.
    """
    point = F.struct("seq", F.array("x", "y").alias("p"))
    rings = vertices.groupBy("area_id", "part", "ring").agg(
        F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("points")
    )
    parts = rings.groupBy("area_id", "part").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda s: s["points"]
        ).alias("rings")
    )
    shapes = parts.groupBy("area_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda s: s["rings"]
        ).alias("coordinates")
    )
    named = shapes.withColumnRenamed("area_id", "_shape_id")
    joined = attributes.join(named, F.col("area_id").eqNullSafe(F.col("_shape_id")), "full")
    joined = joined.withColumn("area_id", F.coalesce("area_id", "_shape_id"))
    return joined.select(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(c) for c in attributes.columns]).alias("properties"),
        F.when(
            F.col("coordinates").isNotNull(),
            F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")),
        ).alias("geometry"),
    )


def write_areas(vertices: DataFrame, attributes: DataFrame, path: str):
    """Write areas with their (smoothed) attribute columns as GeoJSON lines."""
    area_features(vertices, attributes).write.mode("overwrite").json(path)


def column_profile(df: DataFrame) -> DataFrame:
    """Names, types and nullability of the columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, nullable boolean"
    )
