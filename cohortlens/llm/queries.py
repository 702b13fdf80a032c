"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, langid, lexical, line_dedup, minhash, mixing, packing, phrase_index, pieces, suffix_dedup, token_files,
    toxicity, vectors,
)
from .common import Scratch, table
from .tokens import public_tokenizer


def remainder(modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), held_out=remainder(4) == 2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.folder("tokens")
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizer("word_bpe_49k.json"), end_id=2, vocabulary=49_408,
        added_tokens=True,
    )
    manifest = scratch.write(token_files.with_bases(scratch.write(manifest, "shards")), "manifest")
    return token_files.read_token_files(spark, manifest, folder)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("text")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=2, max_len=1024,
        added_tokens=True,
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=remainder(5) == 0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizer("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.encode_pieces(docs, model, decoded_col="decoded", keep=["doc_id"])
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_exact_dedup, op3_language_id, op4_token_files, op5_line_dedup, op6_embedding_near_dedup,
        op7_best_fit_packing, op8_mixing, op9_toxicity,
        op10_minhash_near_dedup, op11_phrase_collocations, op12_lexical_search, op13_sentencepiece,
    )}
