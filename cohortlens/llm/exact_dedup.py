"""Exact deduplication by a tree merge of sorted digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, Scratch, without_spaces


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One digest row per document: the 64-bit digest that orders the runs, and the SHA-256 of the
    normalised text that verifies it; with ``key_col`` also that key, as ``row``."""
    key = [F.col(key_col).alias("row")] if key_col else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), without_spaces(text).alias("norm"), *key
    )
    return rows.select(
        "doc_id", "n_chars", F.xxhash64("norm").alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"),
        *(["row"] if key_col else []),
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, run_rows: int = 100_000,
    key_col: str | None = None,
) -> DataFrame:
    """Group documents whose texts are equal without white space, and name the one that stays.

    Documents are dealt into runs of about ``run_rows`` digests.  Upwards, each round merges
    ``fan_in`` neighbouring runs: equal digests whose SHA-256 agrees become one row with the count
    and the best member (most code points, then smallest identifier).  A round is spread over
    (merged run, digest), so partitions exchange only rows of their own digests and a digest held
    by a third of all documents arrives as at most ``fan_in`` rows a key.  Downwards the result of
    the root returns along the same tree, again at most ``fan_in`` rows a key, and in the last step
    at most one run's rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256.  A null text counts as empty; all empty
    texts form one group.  A null identifier is never preferred to another one.  Rows that repeat an
    identifier and its text count each in group_size and share their decision.  An empty table gives
    no rows; other columns are ignored.

    ``key_col`` names a number that is unique to each row.  It is then a further column of the result, and
    ``kept`` holds for exactly one row of each group: the one with the smallest key among equally good rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(digests(docs, id_col, text_col, key_col), "digests")
    runs = max(1, -(-rows.count() // run_rows))
    rounds = 1
    while fan_in**rounds < runs:
        rounds += 1
    key = F.coalesce("doc_id", F.lit(LAST_ID))
    run = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(fan_in**rounds))
    own = ["doc_id", *(["row"] if key_col else [])]
    rank = F.struct((-F.col("n_chars")).alias("longest"), key.alias("first"), F.col("doc_id").alias("keep_id"), *own[1:])
    rows = rows.select(*own, "digest", "sha", run.alias("run"), rank.alias("best"), F.lit(1).cast("long").alias("n"))
    level = [rows]
    for r in range(rounds + 1):
        merged = level[-1] if r == 0 else level[-1].withColumn("run", F.expr(f"run div {fan_in}"))
        merged = merged.groupBy("run", "digest", "sha").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        level.append(scratch.write(merged, f"level{r}"))
    best = [F.col("best.keep_id").alias("keep_id"), *([F.col("best.row").alias("keep_row")] if key_col else [])]
    found = level[-1].select("run", "digest", "sha", *best, F.col("n").alias("group_size"))
    for r in range(rounds - 1, -2, -1):
        below = level[r + 1].select("digest", "sha", "run", *(own if r < 0 else []))
        parent = F.expr(f"run div {fan_in}") if r >= 0 else F.col("run")
        below = below.withColumn("up", parent)
        above = found.withColumnRenamed("run", "up")
        found = below.join(above, ["up", "digest", "sha"]).drop("up")
    kept = F.col("row") == F.col("keep_row") if key_col else F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row").alias(key_col)] if key_col else []),
    )
