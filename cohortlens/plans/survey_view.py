"""The study's person, laboratory and area tables, derived from the given order tables.

One person is one order, a cluster is a customer, a stratum and state is a nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import constants as K


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person table with survey answers and laboratory signals (null without line items)."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    signals = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.avg(price) / 50).alias("pmmsp1"),
        (F.min(price) / 50 - 100).alias("pomsp1"),
        (F.max(price) / 500).alias("pvmsp1"),
        (F.sum(price) / 500).alias("pfmsp1"),
        (F.avg(price * discount) / 4).alias("hrp2_1"),
        (F.sum("l_quantity") * 2).alias("gst"),
        (F.avg(price) / 200).alias("ama1"),
        (F.max(price) / 200).alias("csp"),
        (F.min(price) / 100).alias("glurp0"),
        (F.sum(price * discount) / 20).alias("hrp2"),
        (F.avg("l_quantity") * 5).alias("lsa1"),
        (F.max(price) / 35).alias("paldo"),
        (F.min(price) / 40).alias("pldh"),
        (F.sum(price * F.col("l_tax")) / 8).alias("pvldh"),
    )
    # answers from text are taken before the joins, which then carry a number and a letter
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("gender"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
    )
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(signals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")

    def answer(x):
        """Survey answer 1, 2, 8 (refused), 9 (unknown) or null from a pseudo-random code."""
        return (
            F.when(x % 20 == 0, None).when(x % 20 == 1, 8).when(x % 20 == 2, 9)
            .otherwise(1 + x % 2).cast("int")
        )

    age = key % 15
    growth = age.cast("double")
    return joined.select(
        key.alias("ptid"),
        F.col("c_nationkey").alias("varstrat"),
        cust.alias("varunit"),
        (key % 3).cast("int").alias("a1qnumber"),
        (cust * 10 + key % 3).alias("hh_id"),
        (price / 500).alias("hhwgt"),
        (price / 1000).alias("ab_wt"),
        (price / 2000).alias("ag_wt"),
        F.col("c_nationkey").alias("ahstate"),
        F.col("n_regionkey").alias("ahzone"),
        (key % 12).cast("int").alias("ahlga"),
        age.cast("int").alias("age"),
        "gender",
        (1 + cust % 2).cast("int").alias("ahtype"),
        F.col("priority").cast("int").alias("wealthquintile"),
        (2 + cust % 9).cast("int").alias("ahmember"),
        answer(key).alias("a1q119"),
        F.when((key % 20 > 2) & (key % 2 == 0), 1 + key % 5).cast("int").alias("a1q120"),
        answer(cust).alias("a1q115"),
        answer(F.floor(key / 4)).alias("a1q105n"),
        answer(F.floor(key / 8)).alias("a1q105a"),
        F.when(key % 11 == 10, 9).otherwise(1 + key % 3).cast("int").alias("a1q101a"),
        F.when(key % 17 == 16, 96).when(key % 17 == 15, 97).otherwise(10 + (key % 30))
        .cast("int").alias("a1q108"),
        F.when(key % 19 == 18, 96).when(key % 19 == 17, 97).otherwise(8 + (key % 31))
        .cast("int").alias("a1q109"),
        "gst", "ama1", "csp", "glurp0", "hrp2", "lsa1", "pfmsp1", "pmmsp1", "pomsp1", "pvmsp1",
        "hrp2_1", "paldo", "pldh", "pvldh",
        F.when((key * 7919) % 1000 < 600 * (1 - F.exp(-0.2 * growth)), 1).otherwise(0).alias("pmpos"),
        F.when((key * 6101) % 1000 < 300 * (1 - F.exp(-0.1 * growth)), 1).otherwise(0).alias("popos"),
    )


def antibody_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with MSP1 flags from the signals (outcomes of the survey estimates)."""
    from cohortlens.operators.recode import antibody_flags

    msp1 = {k: K.IGG_CUTOFFS[k] for k in ("pmmsp1", "pomsp1", "pvmsp1", "pfmsp1")}
    return antibody_flags(persons(spark, sf_dir), msp1)


def lab_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laboratory sub-sample: the samples of one market segment's customers."""
    customer = _read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    chosen = customer.select(F.col("c_custkey").alias("varunit"))
    return all_samples(spark, sf_dir).join(chosen, "varunit")


def all_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A laboratory sample for every order, with a species text."""
    joined = _read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    texts = [*K.SPECIES_FLAGS, None, "unknown"]
    criteria = [*K.SELECTION_CODES, "Other"]
    species = F.array(*[F.lit(t) for t in texts])
    return joined.select(
        key.alias("ptid"),
        species[(key % len(texts)).cast("int")].alias("species_present"),
        F.when(key % 50 == 0, "missing").alias("missing_samples"),
        F.array(*[F.lit(c) for c in criteria])[(key % len(criteria)).cast("int")].alias(
            "selection_criteria"
        ),
        (cust + 100_000).alias("cluster"),
        cust.alias("varunit"),
    )


def area_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster as a unit square on a grid of 40 columns, as closed rings of vertices."""
    customer = _read(spark, sf_dir, "customer")
    col, row = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    corners = F.array(
        *[
            F.struct((col + dx).cast("double").alias("x"), (row + dy).cast("double").alias("y"))
            for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
        ]
    )
    return customer.select(
        F.col("c_custkey").alias("area_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"),
        F.posexplode(corners).alias("seq", "v"),
    ).select("area_id", "part", "ring", "seq", "v.x", "v.y")
