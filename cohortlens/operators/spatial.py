"""Area neighbours, centroids and local empirical-Bayes rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.nulls import ratio
from cohortlens.functions.staging import null_safe, stage


def queen_neighbours(vertices: DataFrame, snap: float = 1e-6) -> DataFrame:
    """Directed pairs of areas with boundary points at most ``snap`` apart.

    Points fall into cells of that width; those of one side also stand in the eight cells around their own, so two
    points that lie close across the edge of a cell meet in an equi-join, and their true distance decides.
    """
    points = vertices.select("area_id", "x", "y").distinct().withColumns(
        {"cx": F.floor(F.col("x") / snap), "cy": F.floor(F.col("y") / snap)}
    )
    near = F.array(*[
        F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)
    ])
    a = points.select(F.col("area_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy")
    b = points.select(F.col("area_id").alias("dst"), "x", "y", F.explode(near).alias("at")).select("dst", "x", "y", "at.*")
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    met = a.join(b, ["cx", "cy"]).where((F.col("src") != F.col("dst")) & (dx * dx + dy * dy <= snap * snap))
    return met.select("src", "dst").distinct()


def link_counts(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours per area, isolated areas with 0."""
    links = edges.groupBy(F.col("src").alias("area_id")).agg(F.count(F.lit(1)).alias("links"))
    ids = areas.select("area_id").distinct()
    return null_safe(ids, links, ["area_id"]).fillna(0, subset=["links"])


def neighbour_summary(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """Regions, links, mean links and isolated areas."""
    return link_counts(areas, edges).agg(
        F.count(F.lit(1)).alias("regions"), F.sum("links").alias("links"),
        F.avg("links").alias("mean_links"), F.min("links").alias("min_links"),
        F.max("links").alias("max_links"), F.count_if(F.col("links") == 0).alias("isolated"),
    )


def link_histogram(areas: DataFrame, edges: DataFrame) -> DataFrame:
    return link_counts(areas, edges).groupBy("links").agg(F.count(F.lit(1)).alias("areas"))


def centroids(vertices: DataFrame) -> DataFrame:
    """Area and centroid of polygons with closed rings; ring 0 is the shell, others are holes.

    Consecutive vertices meet in an equi-join on the next position, so a ring of any length is
    spread over tasks.
    """
    ring = ["area_id", "part", "ring"]
    following = vertices.select(
        *ring, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sides = vertices.join(following, [*ring, "seq"]).withColumn("cross", cross)
    rings = sides.groupBy(*ring).agg(
        (F.sum("cross") / 2).alias("a"),
        (F.sum((F.col("x") + F.col("x2")) * F.col("cross")) / 6).alias("mx"),
        (F.sum((F.col("y") + F.col("y2")) * F.col("cross")) / 6).alias("my"),
    )
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    total = rings.groupBy("area_id").agg(
        F.sum(sign * F.col("a")).alias("area"), F.sum(sign * F.col("mx")).alias("mx"),
        F.sum(sign * F.col("my")).alias("my"),
    )
    return total.select(
        "area_id", "area", F.try_divide("mx", "area").alias("cx"), F.try_divide("my", "area").alias("cy")
    )


def eb_local(
    areas: DataFrame, edges: DataFrame, counts: list[str], n: str = "n", geoda: bool = False
) -> DataFrame:
    """Local empirical-Bayes rates of several counts at once (Marshall 1991).

    Each neighbourhood includes its own area.  ``geoda`` measures the spread of a neighbourhood
    around its own rate instead of each neighbour's.  A neighbourhood without any event gives 0.
    """
    items = F.array(
        *[F.struct(F.lit(c).alias("outcome"), F.col(c).cast("double").alias("r")) for c in counts]
    )
    long = stage(
        areas.select("area_id", F.col(n).cast("double").alias("n"), F.explode(items).alias("o"))
        .select("area_id", "n", "o.outcome", "o.r")
        .withColumn("raw", ratio(F.col("r"), F.col("n")))
    )
    own = areas.select(F.col("area_id").alias("src"), F.col("area_id").alias("dst"))
    hood = stage(edges.select("src", "dst").unionByName(own).distinct())
    member = long.withColumnRenamed("area_id", "dst")
    local = stage(
        hood.join(member, "dst").groupBy("src", "outcome").agg(
            F.sum("r").alias("sr"), F.sum("n").alias("sn"), F.count(F.lit(1)).alias("k")
        )
        .withColumn("m", ratio(F.col("sr"), F.col("sn")))
    )
    rate = local.select(F.col("src").alias("dst"), "outcome", F.col("m").alias("mj"))
    centre = F.col("mi") if geoda else F.col("mj")
    spread = hood.join(member, "dst").join(rate, ["dst", "outcome"])
    if geoda:
        spread = spread.join(local.select("src", "outcome", F.col("m").alias("mi")), ["src", "outcome"])
    c = spread.groupBy("src", "outcome").agg(
        F.sum(F.col("n") * (F.col("raw") - centre) ** 2).alias("c")
    )
    full = (
        local.join(c, ["src", "outcome"]).withColumnRenamed("src", "area_id")
        .join(long, ["area_id", "outcome"])
    )
    mean_n = F.col("sn") / F.col("k")
    a = F.greatest(
        F.lit(0.0), F.try_divide(F.col("c"), F.col("sn")) - F.try_divide(F.col("m"), mean_n)
    )
    shrink = F.try_divide(a, a + F.try_divide(F.col("m"), F.col("n")))
    est = F.col("m") + (F.col("raw") - F.col("m")) * F.coalesce(shrink, F.lit(0.0))
    return full.select(
        "area_id", "outcome", "n", "r", "raw", F.when(F.col("raw").isNotNull(), est).alias("est")
    )
