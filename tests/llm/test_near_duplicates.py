"""Near-duplicates against all pairs by brute force."""

import re

import numpy as np

from cohortlens.llm import minhash, queries

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, n long, uid long, key long, component long, d1 string"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    size_ = min(size, len(words))
    return frozenset(tuple(words[i : i + size_]) for i in range(len(words) - size_ + 1))


def by_hand(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if not sets[i] or 100 * len(sets[i]) < 80 * len(sets[j]):
                if sets[i]:
                    break
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [m for m in members[root(i)] if m is not None]
        first = min(ids) if ids else None
        out.append((d, len(sets[i]), first, d == first))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=repr)


def test_documents(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = by_hand(rows, 4)
    assert sum(not w[3] for w in want) > 20
    assert got(queries.op10_minhash_near_dedup(spark, SF)) == want


def test_chains_copies_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É b c d"), (8, "é b c d"),
            (None, "lonely words in a row"), (None, "one two"), (30, "w " * 30_000), (31, "w " * 20_000), (31, "w " * 20_000)]
    words = [f"t{i}" for i in range(3000)]
    text = list(rng.choice(words, 120))
    for i in range(40):  # a chain: each differs a little from the one before
        text = list(text)
        text[rng.integers(0, 120)] = f"new{i}"
        rows += [(100 + i, " ".join(text)), (200 + i, " ".join(text[:-3]))]
    rows += [(300 + i, "shared passage of some common words " * 3 + " ".join(rng.choice(words, 60))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2, 3, "x") for i, t in rows], DOC).repartition(5)
    for size in (4, 5):
        assert got(minhash.near_duplicates(docs, words=size)) == by_hand(rows, size)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert got(minhash.near_duplicates(docs.where("doc_id < 4"))) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_sketch_never_loses_similar_sets():
    hasher = minhash.MinHasher(60, 7, 1024)
    limit = minhash.sketch_limit(0.8, 420, 1024)
    rng = np.random.default_rng(5)
    for n in (9, 90, 900):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        shared = n * 8 // 9
        for _ in range(30):
            x, y = pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]])
            a, b = hasher.samples(x), hasher.samples(y)
            differ = int(np.unpackbits((hasher.odd_sketch(a) ^ hasher.odd_sketch(b)).view(np.uint8)).sum())
            assert differ <= limit and (hasher.band_keys(a) == hasher.band_keys(b)).any()
            rng.shuffle(pool)


def test_reference_sql_parts_words_like_the_operator(spark):
    import duckdb

    from cohortlens.llm import sql

    rows = [(1, "a\r\nb\r\nc\r\nd"), (2, "a b c d"), (3, "a\x0bb\x0cc\td e"), (4, "A B C D"), (5, None), (6, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(sql.OP10).fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs, words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, out.collect())) == want
    assert [r[2] for r in want] == [1, 1, 3, 1, 5, 6]
