"""Mixing sources to target weights in fixed-length blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, fraction_of, with_row_key

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Adds rank, weight and target to (source, source_size): one row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight until none is above.
    That fixed point is a water level: sources sorted by cap / weight are capped up to the first one that stays
    below its cap when all later ones share what is left.  The windows run over sources only.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left_size") / F.col("left_weight"))
    below = F.col("level") * F.col("weight") <= F.col("most")
    found = F.min_by("level", F.when(below, F.col("most") / F.col("weight"))).over(everything)
    s = s.withColumn("found", found)
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("found") * F.col("weight"), F.col("most").cast("double")))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def permuted(x: Column, n: Column, *key: Column, seed: int, rounds: int = 16) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by ``key``, at x: swap-or-not rounds.

    Each round pairs x with K - x (mod n) and swaps both or neither by a hash bit of the larger one, so every
    round is a permutation of exactly n values for any n; no table, no walk.
    """

    def one(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), i, *key), n) - x, n)
        bit = F.xxhash64(F.lit(seed + 1), i, *key, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), x.cast("long"), one)


def document_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None
) -> DataFrame:
    """doc_id, source, size (words of the text, 0 for null), and ``key_col`` as uid, or else a row number that is unique
    in the written table."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    uid = F.col(key_col) if key_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), uid.alias("uid"))


class Mix:
    """A mixture of documents, planned and drawn when made.

    Words of each source form one stream of documents in pseudorandom order, cut into blocks of
    ``block`` words.  A source's quota is the number of blocks nearest its target.  Every shard of
    ``shard_blocks`` slots draws multinomial source counts; when the running count of a source passes its quota,
    the rest of its draws goes to the sources that end below theirs, so the totals are the quotas.  A source's
    j-th slot takes block permutation(j mod blocks) of epoch j div blocks: no block comes a second time before
    each came once, and none more than ``cap`` times.

    ``sizes``: one row per document (doc_id, source, size, uid, rank, first word in its stream).
    ``targets``: one row per source.  ``slots``: shard, position, rank (of the source), epoch, block.
    A null source is a source of its own, the last.  Empty documents take part with no word.  An empty table gives
    empty results; repeated rows are documents of their own.
    """

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 64, shard_blocks: int = 16_384, seed: int = 42,
        salt_rows: int = 50_000, key_col: str | None = None,
    ):
        self.spark, self.block, self.cap, self.seed = docs.sparkSession, block, cap, seed
        self.names = (key_col, text_col)
        self.scratch = Scratch(self.spark)
        sizes = self.scratch.write(document_sizes(docs, id_col, text_col, source_col, key_col), "sizes")
        per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        blocks = F.expr(f"(source_size + {block - 1}) div {block}")
        targets = source_targets(per_source, weights, cap).withColumn("blocks", blocks)
        quota = F.when(F.col("blocks") > 0, F.rint(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
        self.targets = self.scratch.write(targets.withColumn("quota", quota.cast("long")), "targets")
        self.sizes = self._streams(sizes, salt_rows)
        self.slots = self._slots(shard_blocks)

    def _streams(self, sizes: DataFrame, salt_rows: int) -> DataFrame:
        """Each document's first word in the stream of its source: prefix sums over salts, then inside a salt."""
        ranks = self.targets.select(F.col("source").alias("s"), "rank")
        rows = sizes.join(ranks, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
        salts = max(64, -(-sizes.count() // salt_rows))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.lit(salts)))
        before = Window.partitionBy("rank").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        shifts = rows.groupBy("rank", "salt").agg(F.sum("size").alias("words")).select(
            "rank", "salt", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("shift")
        )
        shifts = self.scratch.write(shifts, "shifts")
        inside = Window.partitionBy("rank", "salt").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(shifts, ["rank", "salt"])
        return self.scratch.write(
            rows.select("doc_id", "uid", "rank", "size", (F.col("inside") + F.col("shift")).alias("first")), "streams"
        )

    def _drawn(self, total: int, shard_blocks: int) -> DataFrame:
        """Multinomial counts (shard, rank, n): a uniform number per slot falls into a source's share of [0, 1)."""
        grid = 1024
        upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        shares = self.targets.where("quota > 0").withColumn("upto", F.sum("quota").over(upto))
        shares = shares.select("rank", ((F.col("upto") - F.col("quota")) / total).alias("low"), (F.col("upto") / total).alias("high"))
        cells = F.sequence(F.floor(F.col("low") * grid), F.floor(F.col("high") * grid))
        shares = self.scratch.write(shares.withColumn("cell", F.explode(cells)), "shares")
        slots = self.spark.range(total).select(
            F.expr(f"id div {shard_blocks}").alias("shard"), fraction_of(F.col("id"), seed=self.seed + 7).alias("u")
        )
        slots = slots.withColumn("cell", F.floor(F.col("u") * grid))
        found = slots.join(shares, "cell").where("u >= low AND u < high")
        return found.groupBy("shard", "rank").agg(F.count("*").alias("n"))

    def _slots(self, shard_blocks: int) -> DataFrame:
        total = self.targets.agg(F.sum("quota")).first()[0] or 0
        if not total:
            return self.spark.range(0).selectExpr(
                "id AS shard", "id AS position", "CAST(id AS int) AS rank", "id AS epoch", "id AS block"
            )
        drawn = self.scratch.write(self._drawn(total, shard_blocks), "drawn")
        quotas = self.targets.select("rank", "quota")
        upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        run = drawn.withColumn("upto", F.sum("n").over(upto)).join(quotas, "rank")
        kept = run.select(
            "shard", "rank", (F.least("upto", "quota") - F.least(F.col("upto") - F.col("n"), F.col("quota"))).alias("n")
        )
        kept = self.scratch.write(kept, "kept")
        # what the quotas cut off in a shard, slot by slot, meets what sources are short of, block by block
        size = F.least(F.lit(shard_blocks), F.lit(total) - F.col("shard") * shard_blocks)
        holes = kept.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (size - F.col("n")).alias("holes"))
        short = quotas.join(kept.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left")
        short = short.select("rank", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("short"))

        def numbered(df: DataFrame, key: str, count: str) -> DataFrame:
            df = df.where(F.col(count) > 0)
            before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
            first = F.coalesce(F.sum(count).over(before), F.lit(0))
            return df.select(key, first.alias("first"), count).select(
                key, F.explode(F.sequence("first", F.col("first") + F.col(count) - 1)).alias("i")
            )

        filled = numbered(holes, "shard", "holes").join(numbered(short, "rank", "short").hint("merge"), "i")
        filled = filled.groupBy("shard", "rank").agg(F.count("*").alias("n"))
        counts = kept.unionByName(filled).groupBy("shard", "rank").agg(F.sum("n").alias("n")).where("n > 0")
        before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        counts = counts.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        counts = self.scratch.write(counts.join(self.targets.select("rank", "blocks"), "rank"), "counts")
        # a row becomes up to a shard of rows: dealt by number, which adaptive execution leaves as it is
        parts = max(2 * self.spark.sparkContext.defaultParallelism, -(-total // 200_000))
        step = F.explode(F.expr("sequence(0, n - 1, 1024)"))
        pieces = counts.withColumn("from", step).repartition(parts, "shard", "rank", "from")
        slots = pieces.withColumn("k", F.explode(F.expr("sequence(from, least(from + 1024, n) - 1)")))
        j = F.col("first") + F.col("k")
        slots = slots.select(
            "shard", "rank", "blocks", (F.col("at") + F.col("k")).alias("position"), j.alias("j"),
            F.expr("(first + k) div blocks").alias("epoch"),
        )
        block = permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.col("rank"), F.col("epoch"), seed=self.seed + 13)
        return slots.select("shard", "position", "rank", "epoch", block.alias("block"))

    def document_blocks(self) -> DataFrame:
        """Index of the blocks: rank, block, uid and the words of the document that stand in the block."""
        b = self.block
        rows = self.sizes.where("size > 0").select(
            "uid", "rank", "first", "size", F.explode(F.expr(f"sequence(first div {b}, (first + size - 1) div {b})")).alias("block")
        )
        words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b) - F.greatest("first", F.col("block") * b)
        return rows.select("rank", "block", "uid", words.alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, source: the words of each document in the mix, repeats counted."""
        uses = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
        # both sides come out of explode, whose size the planner cannot see: never a broadcast
        got = self.document_blocks().join(uses.hint("merge"), ["rank", "block"])
        got = got.groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        rows = self.sizes.join(got, "uid", "left").join(self.targets.select("rank", "source", "source_size", "target"), "rank")
        return rows.select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
        )


    def texts(self, docs: DataFrame) -> DataFrame:
        """``docs``, all columns, once for each epoch that takes words from a document, with those words as its text.

        An epoch that takes all words keeps the text as it is; else the words of its blocks follow each other,
        parted by blanks.  Documents without words are not drawn.  Rows and draws meet by the mixture's ``key_col``.
        Columns may have any name, those used here included; an empty table gives no rows.
        """
        key_col, text_col = self.names
        uses = self.slots.select("rank", "epoch", "block")
        drawn = self.document_blocks().join(uses.hint("merge"), ["rank", "block"])
        drawn = drawn.groupBy("uid", "epoch").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list("block")).alias("blocks"))
        one = self.sizes.select("uid", "first", "size")
        drawn = self.scratch.write(drawn.join(one, "uid"), "drawn_texts")
        # the document travels as one column, so that its columns may have any name
        rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key_col).alias("doc_key"))
        rows = rows.join(drawn.hint("merge"), F.col("doc_key") == F.col("uid"))
        text = F.col("doc")[text_col]
        rows = rows.withColumn("words", F.regexp_extract_all(text, F.lit(WORDS), 0))
        b = self.block

        def part(k):
            low = F.greatest(F.lit(0).cast("long"), k * b - F.col("first"))
            high = F.least(F.col("size"), (k + 1) * b - F.col("first"))
            return F.slice("words", (low + 1).cast("int"), (high - low).cast("int"))

        # `words` is used twice, so Spark keeps it as a column instead of extracting anew in the lambda
        cut = F.array_join(F.flatten(F.transform("blocks", part)), " ")
        whole = (F.col("n") == F.col("size")) | (F.size("words") == 0)
        made = F.when(whole, text).otherwise(cut)
        return rows.select(*[(made if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The texts of the mixture; see ``Mix.texts``.

    Null and empty texts are not drawn, rows that repeat an identifier (or have none) are documents of their own, very
    long texts are cut at blocks of words, and columns of any name come back as they are.
    """
    keyed = with_row_key(docs, Scratch(docs.sparkSession))
    return Mix(keyed, key_col=ROW_KEY, **options).texts(keyed).select(*docs.columns)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with the number of words the mixture takes from each; see ``Mix``.

    Null and empty texts have size 0, a null source is the last, repeated rows are documents of their own, an empty
    table gives no rows, and other columns are ignored.
    """
    return Mix(docs, **options).taken()
