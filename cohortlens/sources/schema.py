"""Canonical schemas of the person and laboratory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INT_COLUMNS = """
varstrat a1qnumber ahzone ahstate ahlga age gender ahtype wealthquintile ahmember a1q119 a1q120
a1q115 a1q105n a1q105a a1q101a a1q108 a1q109
""".split()
DOUBLE_COLUMNS = """
hhwgt ab_wt ag_wt gst ama1 csp glurp0 hrp2 lsa1 pfmsp1 pmmsp1 pomsp1 pvmsp1 hrp2_1 paldo pldh pvldh
""".split()

PERSON = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("ptid", "hh_id", "varunit")]
    + [T.StructField(c, T.IntegerType()) for c in INT_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in DOUBLE_COLUMNS]
)

LAB = T.StructType(
    [
        T.StructField("ptid", T.LongType()),
        T.StructField("species_present", T.StringType()),
        T.StructField("missing_samples", T.StringType()),
        T.StructField("selection_criteria", T.StringType()),
        T.StructField("cluster", T.LongType()),
    ]
)


def check_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema`` order; names match without case, a missing one is an error."""
    have = {c.lower() for c in df.columns}
    missing = [f.name for f in schema if f.name.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].try_cast(f.dataType).alias(f.name) for f in schema])
