"""Shared pieces of the training-data operators: written intermediate tables, components, text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.staging import staging_dir

# The white space that the contracts name: blank and the five ASCII controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
# Rows without an identifier sort after all others.
LAST_ID = 2**63 - 1


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, for workers that cannot import it from their own path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="cohortlens-"), "cohortlens.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("cohortlens", os.path.relpath(path, package)))
    context.addPyFile(target)  # served by the driver, so its own folder will do


class Scratch:
    """Written intermediate tables below the cluster's shared folder (``spark.checkpoint.dir``).

    A table is written by Spark's own writer and read back, so later steps restart from files
    after the loss of any executor.  ``drop`` removes a table that nothing lazy reads any more.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._frames: list[DataFrame] = []

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        self._frames.append(back)  # held, so that its id stays its own
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(self._paths.pop(id(df), None))

    def keep_only(self, *frames: DataFrame) -> None:
        """Remove all tables but those that a result still reads."""
        kept = {id(df) for df in frames}
        for key in [k for k in self._paths if k not in kept]:
            self._delete(self._paths.pop(key))

    def _delete(self, path: str | None) -> None:
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Name of the column that ``with_row_key`` adds.
ROW_KEY = "_row_key"


def with_row_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a number that is unique to each row and the same in every read.

    A row of a file is numbered by its file, in order of the paths, and its place there, so no text is copied; any
    other table is written with its numbers.
    """
    try:
        paths = docs.select(F.col("_metadata.file_path").alias("_path")).distinct()
        paths.schema  # resolved now: only tables of files have these columns
    except AnalysisException:
        return scratch.write(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")
    number = F.row_number().over(Window.orderBy("_path")).cast("long")
    files = scratch.write(paths.select("_path", number.alias("_file")), "files")
    placed = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")
    )
    # one short row a file: the planner sees the written size, and broadcasts it while that is small
    placed = placed.join(files, "_path")
    return placed.select(*[F.col("_doc")[c].alias(c) for c in docs.columns], F.expr("shiftleft(_file, 40) + _at").alias(ROW_KEY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_spaces(text: Column) -> Column:
    """The text without any character of ``SPACES``; plain byte searches, no regular expression."""
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def fraction_of(*cols: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex that is not the smallest of its connected component.

    ``edges`` has long columns a, b.  Each round hooks every vertex on its smallest smaller
    neighbour, follows the pointers to their roots by doubling, and replaces both ends of each edge
    by the roots; edges inside one root vanish, so the edge list shrinks until none is left.  All
    state is a table; the driver sees one flag a step.  Vertices missing from the result are the
    smallest of their component.  No edges: an empty result.
    """
    a, b = F.col("a"), F.col("b")

    def oriented(df: DataFrame) -> DataFrame:
        return df.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    live = scratch.write(oriented(edges), "edges")
    labels = live.select(a.alias("id"), b.alias("component")).limit(0)
    while not live.isEmpty():
        parent = scratch.write(live.groupBy("a").agg(F.min("b").alias("p")), "parent")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.write(
                parent.select("a", "p").join(up, "p", "left")
                .select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump",
            )
            scratch.drop(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        root = parent.select(F.col("a").alias("v"), F.col("p").alias("r"))
        moved = labels.join(root, F.col("component") == F.col("v"), "left").select(
            "id", F.coalesce("r", "component").alias("component")
        )
        new_labels = scratch.write(moved.union(root.select("v", "r")), "labels")
        one = live.join(root, a == F.col("v"), "left").select(F.coalesce("r", "a").alias("a"), "b")
        two = one.join(root, b == F.col("v"), "left").select("a", F.coalesce("r", "b").alias("b"))
        shrunk = scratch.write(oriented(two), "edges")
        scratch.drop(live, labels, parent)
        live, labels = shrunk, new_labels
    return labels
