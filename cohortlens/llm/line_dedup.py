"""Line deduplication: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, SPACES, Scratch, lower_ascii


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_docs: int = 1
) -> DataFrame:
    r"""Drop the lines whose key stands in more than ``max_docs`` documents, but for its first document.

    The lines at \n, their keys' 128-bit hashes and positions are written once.  Per hash the smallest
    identifier and, by a partial aggregate, whether another document has it; only repeated hashes
    meet the lines again (a shuffle join that adaptive execution splits for a hot line).  The dropped
    positions of a row return to it, and the kept lines are cut out between them, in time linear in
    the text.

    Returns doc_id, n_lines, n_dropped, text (the kept lines), kept_sha256.  A null or empty text is one
    empty line.  A line found several times in one document counts as one document.  Rows that repeat
    an identifier belong to one document, told apart by their text; null identifiers are one
    document, the last.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("key"),
        F.xxhash64(text).alias("row"), text.alias("text"),
    )
    lines = rows.select("key", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("key", "row", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    keys = scratch.write(
        keys.select("key", "row", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(11), "k").alias("h2")), "lines"
    )
    if max_docs == 1:
        repeated = keys.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        repeated = repeated.where(F.col("first") < F.col("last"))
    else:
        per_doc = keys.select("h1", "h2", "key").distinct()
        repeated = per_doc.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("n"))
        repeated = repeated.where(F.col("n") > max_docs)
    # written, so that both sides of the join are plain exchanges and a hot line's rows can be split
    repeated = scratch.write(repeated.select("h1", "h2", "first"), "repeated")
    drops = (
        keys.join(repeated, ["h1", "h2"]).where(F.col("key") > F.col("first"))
        .groupBy("key", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    joined = rows.join(drops, ["key", "row"], "left")
    cut = joined.select("doc_id", "text", "drops", F.split("text", "\n", -1).alias("lines"))
    n_dropped = F.coalesce(F.size("drops").cast("long"), F.lit(0))
    n_dropped = F.when(F.col("drops").isNull(), F.lit(0).cast("long")).otherwise(n_dropped)
    # `lines` is used twice, so Spark keeps it as a column of its own instead of splitting anew in the lambda
    ends = F.concat("drops", F.array(F.size("lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("drops", lambda p: p + 1))
    parts = F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    out = cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("text"))
    return out.withColumn("kept_sha256", F.sha2("text", 256))
