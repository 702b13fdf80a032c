"""Repeated byte strings against a dictionary of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import queries, suffix_dedup
from cohortlens.llm.phrases import Parsed

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, key long, row long, uid long, n long, h long"


def by_hand(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        until = -1
        for p in range(len(d)):
            if p + length <= len(d) and seen[d[p : p + length]] > 1:
                until = p + length
            gone[p] = p < until
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=repr)


def test_documents(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = by_hand(rows, 400)
    assert sum(w[2] > 0 for w in want) > 10
    assert got(queries.op1_suffix_dedup(spark, SF)) == want


def corpus(seed):
    rng = np.random.default_rng(seed)

    def noise(n, letters="abcdefgh é"):
        return "".join(rng.choice(list(letters), n))

    shared = [noise(n) for n in (39, 40, 41, 75, 120, 300)]
    rows = [(None, "short"), (1, None), (2, ""), (3, "ab" * 120), (4, "a" * 150), (5, "a" * 39), (6, "a" * 40)]
    for i in range(10, 60):
        parts = [noise(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(1, 4))):
            s = shared[rng.integers(len(shared))]
            cut = int(rng.integers(0, 12))
            parts += [s[cut : len(s) - int(rng.integers(0, 12))], noise(int(rng.integers(0, 50)))]
        rows.append((i, "".join(parts)))
    copy = noise(200)
    rows += [(70, copy), (70, copy), (71, copy[:90] + "#" + copy[91:]), (72, noise(90, "ab")), (73, noise(5000, "abc") * 2), (None, copy[5:])]
    return rows


@pytest.mark.parametrize("seed,window,max_group", [(1, 16, 2048), (2, 24, 2048), (3, 16, 1), (4, 24, 5)])
def test_random_texts(spark, seed, window, max_group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], DOC).repartition(3)
    assert got(suffix_dedup.remove_repeats(docs, length=40, window=window, max_group=max_group)) == by_hand(rows, 40)


def test_kept_bytes_and_empty_table(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], DOC)
    out = suffix_dedup.remove_repeats(docs, length=40, window=16, keep_bytes=True).collect()
    assert len(out) == len(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    alone = suffix_dedup.remove_repeats(docs.where("doc_id = 5")).first()
    assert (alone["n_bytes"], alone["n_removed"]) == (39, 0)


def test_triggers_depend_on_the_stretch_alone():
    rng = np.random.default_rng(0)
    piece = rng.integers(97, 100, 300, dtype=np.uint8).tobytes()
    a = Parsed(b"xyz" * 30 + piece + b"tail" * 40, 48)
    b = Parsed(piece + b"other" * 40, 48)
    n = len(piece) - 48 - 16 + 2
    assert (a.trigger[90 : 90 + n] - 90 == b.trigger[:n]).all()
    start, end = np.array([100, 120]), np.array([140, 290])
    assert (a.hash(start, end) == b.hash(start - 90, end - 90)).all()
