"""Vector links against all pairs in double precision."""

import numpy as np

from cohortlens.llm import queries, vectors

SF = "/root/testdata/sf0.01"
VEC = "vec_id long, embedding array<double>, uid long, dim int, copies string"


def by_hand(rows, cosine):
    n = len(rows)
    units = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0
        u = np.array(v, float) / np.abs(v).max() if ok else None
        units.append(None if u is None else u / np.linalg.norm(u))
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
              and units[i] @ units[j] >= cosine] for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen |= {k: min(ids) if ids else None for k in group}
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=repr)


def planted(seed, n, dim):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    at = n
    for c in range(12):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(2, 30))):
            rows.append((at, (centre + rng.normal(size=dim) * (0.15 + 0.02 * c)).tolist()))
            at += 1
    return rows, at, rng


def test_clusters_and_odd_vectors(spark):
    rows, at, rng = planted(1, 150, 32)
    base = rows[0][1]
    rows += [(at, base), (at + 1, base), (at + 1, base), (at + 2, [3 * x for x in base]), (at + 3, [-x for x in base]), (at + 4, None), (at + 5, []),
             (at + 6, [0.0] * 32), (at + 7, [0.0] * 32), (at + 8, [float("nan")] + base[1:]), (at + 9, [None] + base[1:]),
             (at + 10, [float("inf")] + base[1:]), (at + 11, base[:16]), (None, rows[1][1]), (None, rng.normal(size=32).tolist()),
             (at + 12, [1e300 * x for x in base]), (at + 13, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VEC).repartition(4)
    want = by_hand(rows, 0.9)
    assert sum(w[1] > 0 for w in want) > 50
    assert got(vectors.near_vectors(df)) == want
    assert got(vectors.near_vectors(df, block=7)) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_embeddings(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert got(queries.op6_embedding_near_dedup(spark, SF)) == by_hand(rows, 0.9)


def test_recall_at_the_threshold():
    assert vectors.miss_probability(0.9, 16, vectors.table_count(0.9, 16, 1e-4)) <= 1e-4
    rng = np.random.default_rng(3)
    planes = vectors.hyperplanes(64, 1)
    masks = vectors.table_masks(12, vectors.table_count(0.9, 12, 1e-4), 1)
    for _ in range(200):
        u, v = rng.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        v -= (u @ v) * u
        w = 0.9 * u + np.sqrt(1 - 0.81) * v / np.linalg.norm(v)
        x = np.packbits(u @ planes > 0).view(np.uint64) ^ np.packbits(w @ planes > 0).view(np.uint64)
        assert np.bitwise_count(x).sum() <= vectors.sign_limit(0.9)
        assert ((x & masks) == 0).all(axis=1).any()
