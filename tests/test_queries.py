"""Every registered query against its reference SQL on the smallest tables."""

import re

import pytest
from compare import differences, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# covered on their own fixtures in test_models.py and test_sweeps.py
SLOW = {"glmm", "glmm_nested", "glmm_bivariate", "mixture2", "mixture_density", "glmm_binned", "glmm_collinearity",
        "glmm_performance", "firth_binned", "firth_collinearity"}
# tested beside their own subpackage, which may be absent
OWN = {n for n in entry.queries() if re.match(r"(op\d+_|pipeline$)", n)}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ahstate", "n", "estimate", "se", "ci_low", "ci_high"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW - OWN))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    res = duck(SF).execute(SQL[name])
    cols = [c[0] for c in res.description]
    assert differences(df.columns, rows, cols, res.fetchall()) is None
