"""Training-data pipeline: toxicity, exact and near duplicates, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's
documents; all but the last return the columns of ``documents``.  The two deduplications and the mixture tell rows
apart by a key that is written with their input, not by identifier: of equal or similar rows exactly one stays, also
where rows share an identifier or have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup, minhash, mixing, packing, queries, toxicity
from cohortlens.llm.common import ROW_KEY, Scratch, table, with_row_key
from cohortlens.llm.tokens import public_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept_rows(docs: DataFrame, decide: Callable[..., DataFrame], **options) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, joined by row key."""
    keyed = with_row_key(docs, Scratch(docs.sparkSession))
    dropped = decide(keyed, key_col=ROW_KEY, **options).where("NOT kept").select(ROW_KEY)
    return keyed.join(dropped, ROW_KEY, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; learned from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels")
    kept = toxicity.clean_documents(docs, labels, held_out=queries.remainder(5) == 0)
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept_rows(docs, exact_dedup.exact_duplicates)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: shingles of five words, similarity 0.8."""
    return _kept_rows(docs, minhash.near_duplicates, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each document and epoch that takes words from it, with those words as its text."""
    mixed = mixing.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), end_id=2, max_len=1024, added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the learned model, the hashed draws or the fitted patterns; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
