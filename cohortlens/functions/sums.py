"""Sums of small per-batch arrays over a distributed table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def array_sums(
    df: DataFrame, fn: Callable[[pd.DataFrame | pa.RecordBatch], dict[str, np.ndarray]], arrow: bool = False
) -> dict[str, np.ndarray]:
    """Σ over Arrow batches of ``fn(batch)``, a dict of short vectors.

    Each task adds its batches up and emits one row per vector element; the vectors are a few
    hundred numbers whatever the size of the table, so only they reach the driver.  With ``arrow``
    a batch arrives as it is, so binary columns are not copied.
    """

    def task(batches: Iterator[pd.DataFrame | pa.RecordBatch]) -> Iterator[pd.DataFrame | pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows if arrow else len(batch):
                for key, value in fn(batch).items():
                    total[key] = total.get(key, 0.0) + value
        for key, value in total.items():
            out = pd.DataFrame({"key": key, "pos": np.arange(len(value)), "value": value})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False) if arrow else out

    schema = "key string, pos long, value double"
    rows = (
        (df.mapInArrow(task, schema) if arrow else df.mapInPandas(task, schema))
        .groupBy("key", "pos").agg(F.sum("value").alias("value")).collect()
    )
    out: dict[str, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r["key"], {})[r["pos"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}
