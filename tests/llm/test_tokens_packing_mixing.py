"""Token files, packing and mixing against brute force."""

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing, packing, queries, token_files
from cohortlens.llm.common import Scratch
from cohortlens.llm.tokens import TextEncoder, public_tokenizer

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, salt int, rank int, length long"
ODD = [
    (7, None), (3, ""), (5, " "), (9, "a  b\n\n c\t\td   e f x\x1cy"), (4, "I'll can't <|endoftext|> x" * 3),
    (8, "Éé ΑΣ ß ́ 𝔘 中文 字\r\n"), (10, "word " * 9000), (11, "w" * 5000), (12, "a\u0085b  "), (12, "a\u0085b  "),
    (None, "no id"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3) for i, t, s in rows], DOC)


@lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer(name))
    t.encode_special_tokens = True
    return t


def whole(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name):
    import duckdb

    encoder = TextEncoder(public_tokenizer(name), 2, max_words=50)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + [t for _, t in ODD]
    rng = np.random.default_rng(0)
    signs = list(" \n\t\r\x0b\x1c\x1f  ́ab'sZé1!<|>🙂中")
    texts += ["".join(rng.choice(signs, 30)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(encoder.document(text), "<u4").tolist() == whole(name, text) + [2]


def test_token_files(spark):
    scratch = Scratch(spark)
    folder = scratch.folder("tokens")
    path = public_tokenizer("word_bpe_49k.json")
    docs = frame(spark, [(i, t, "s") for i, t in ODD]).repartition(4)
    manifest = scratch.write(token_files.write_token_files(docs, folder, path, 2, 49_408))
    manifest = scratch.write(token_files.with_bases(manifest))
    got = [tuple(r) for r in token_files.read_token_files(spark, manifest, folder).collect()]
    at, want = 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(whole("word_bpe_49k.json", t) + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    empty = token_files.write_token_files(docs.limit(0), folder, path, 2, 49_408)
    assert token_files.read_token_files(spark, token_files.with_bases(scratch.write(empty)), folder).count() == 0


def check_packing(rows, texts, max_len):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    for i, t in texts:
        ids = whole("byte_bpe_50k.json", t) + [2]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // max_len)))
        for r in mine:
            assert len(ids) > max_len or (r["start"], r["length"]) == (0, len(ids))
            assert r["piece"] == 0 or r["length"] == max_len
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(r["length"] for r in mine) == len(ids)
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // max_len)


def test_packing_of_documents(spark):
    import duckdb

    rows = queries.op7_best_fit_packing(spark, SF).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    used, least = check_packing(rows, texts, 1024)
    assert used <= 1.02 * least + 1


def test_packing_of_odd_texts(spark):
    texts = list({i: t for i, t in ODD}.items())
    docs = frame(spark, [(i, t, "s") for i, t in texts])
    path = public_tokenizer("byte_bpe_50k.json")
    check_packing(packing.pack_documents(docs, path, 2, 64).collect(), texts, 64)
    assert packing.pack_documents(docs.limit(0), path, 2, 64).count() == 0
    assert packing.pack_documents(frame(spark, [(1, "a", "s")] * 3), path, 2, 64).count() == 3


def test_plan_uses_every_document():
    rng = np.random.default_rng(3)
    for n in (1, 50, 20_000):
        hist = np.bincount(rng.integers(1, 129, n) ** 2 // 128 + 1, minlength=130)[:129].astype(np.int64)
        seen = np.zeros_like(hist)
        plan = packing.plan_patterns(hist, 128)
        for lengths, k in plan:
            assert sum(lengths) <= 128
            for v in lengths:
                seen[v] += k
        assert (seen == hist).all()
        assert sum(k for _, k in plan) <= 1.03 * (hist @ np.arange(129)) / 128 + 3


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        share = sum(weight[s] for s in rest)
        left = total - sum(capped.values())
        above = [s for s in rest if left * weight[s] / share > 3 * sizes[s]]
        if not above:
            return capped | {s: left * weight[s] / share for s in rest}
        capped |= {s: 3 * sizes[s] for s in above}


def check_mix(rows, near):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, got = targets_by_hand(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(got[s] - want[s]) <= near + 0.01 * want[s], s


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 200 and all(r["size"] > 0 for r in rows)
    check_mix(rows, 128)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "x " * 9, None), (3, "x " * 9, None), (4, "y " * 50_000, "a"), (5, "\t z\x0b", "Z"),
            (None, "q q", "é")]
    out = mixing.mix_documents(frame(spark, rows), block=4, shard_blocks=256).collect()
    assert sorted(r["size"] for r in out) == [0, 0, 1, 2, 9, 9, 50_000]
    check_mix(out, 8)
    assert mixing.mix_documents(frame(spark, rows[:2])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix_documents(frame(spark, rows).limit(0)).count() == 0


def test_mix_slots(spark):
    docs = frame(spark, [(i, "w " * (i % 37 + 1), "abc"[i % 3]) for i in range(900)])
    mix = mixing.Mix(docs, block=4, shard_blocks=256, salt_rows=100)
    quota = {r["rank"]: (r["quota"], r["blocks"]) for r in mix.targets.collect()}
    slots = mix.slots.collect()
    total = sum(q for q, _ in quota.values())
    assert sorted((r["shard"], r["position"]) for r in slots) == [(k // 256, k % 256) for k in range(total)]
    for rank, (q, blocks) in quota.items():
        epochs = defaultdict(list)
        for r in slots:
            if r["rank"] == rank:
                epochs[r["epoch"]].append(r["block"])
        assert sum(map(len, epochs.values())) == q
        for e, found in epochs.items():
            assert len(set(found)) == len(found) and max(found) < blocks
            assert e == max(epochs) or len(found) == blocks


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), seed=1).alias("p"))
        assert sorted(r["p"] for r in x.collect()) == list(range(n))
