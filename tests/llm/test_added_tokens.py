"""Texts that quote added tokens, against the library's encode without any setting."""

import zlib
from functools import lru_cache

import numpy as np
import pytest

import corpus_pipeline
from cohortlens.llm import queries
from cohortlens.llm.tokens import TextEncoder, public_tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "hello <|endoftext|> there", "<|startoftext|>a b<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n\n z",
    "<|ENDOFTEXT|> <|endoftext", "plain words", " <|endoftext|> é", "w <|endoftext|> " * 700, None,
]


@lru_cache
def untouched(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer(name))


def whole(name, text):
    return untouched(name).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_finds_added_tokens(name):
    encoder = TextEncoder(public_tokenizer(name), 2, max_words=50, added_tokens=True)
    rng = np.random.default_rng(3)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", "a", "Bé", "'s", "1", "<|", "|>", "\x1c", "中"]
    texts = TEXTS + ["".join(rng.choice(parts, 25)) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(encoder.document(text), "<u4").tolist() == whole(name, text)


def test_queries_find_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(TEXTS)], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, []
    for k, t in enumerate(TEXTS):
        ids = np.array(whole("word_bpe_49k.json", t), "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op4_token_files(spark, str(tmp_path)).collect()) == want
    lengths = {k: len(whole("byte_bpe_50k.json", t)) for k, t in enumerate(TEXTS)}
    for packed in (queries.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        got = dict.fromkeys(lengths, 0)
        for r in packed.collect():
            got[r["doc_id"]] += r["length"]
        assert got == lengths
