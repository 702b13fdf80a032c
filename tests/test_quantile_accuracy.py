"""The number of cells of a pass decides how fast quantiles narrow, not what they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [2, 1000])
def test_accuracy_changes_no_quantile(spark, accuracy):
    df = spark.range(3_000).select((F.pow("id", F.lit(3.0)) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("x"))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    row = exact_quantiles(df, "x", probs, small=400, accuracy=accuracy).first()
    ids = np.arange(3_000.0)
    assert row["n"] == 3_000
    assert np.allclose(row["q"], np.quantile(ids**3 * np.where(ids % 2 == 0, 1, -1), probs), rtol=1e-12)


def test_a_pass_without_cells_is_an_error(spark):
    with pytest.raises(ValueError, match="at least 2"):
        exact_quantiles(spark.range(5), "id", [0.5], accuracy=1)
