"""Exact and line deduplication against reference SQL and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from compare import differences, duck

from cohortlens.llm import exact_dedup, line_dedup, queries, sql
from cohortlens.llm.common import Scratch, components

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, run int, best int, key string, row long, pos int, line string, digest string, n long"
ROWS = [
    (5, None), (2, ""), (9, " \n\t"), (4, "Hello  world"), (3, "Hello world "), (8, "Helloworld"), (7, "Hello world "), (7, "Hello world "),
    (None, "Hello world extra"), (1, "Hello world extra"), (None, "alone"), (6, "É x"), (10, "É  x"), (11, "é x"),
    (12, "word " * 200_000), (13, "word\n" * 200_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, 4, "l", "d", 5) for i, t in rows], DOC).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_reference_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    res = duck(SF).execute(sql.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert differences(df.columns, [tuple(r) for r in df.collect()], cols, res.fetchall()) is None


def copies_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, sha(norm)) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in,run_rows", [(16, 100_000), (2, 3), (3, 1)])
def test_copies(spark, fan_in, run_rows):
    rows = ROWS + [(100 + i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), fan_in=fan_in, run_rows=run_rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == copies_by_hand(rows)
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def lines_by_hand(rows, min_chars=10, max_docs=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    last = 2**63
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines, me = (t or "").split("\n"), last if i is None else i
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) > max_docs and min(holders[key(x)]) < me for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), sha(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    shared = "A line that many documents share"
    rows = [(1, f"first\n{shared}\n\n{shared.upper()} \nlast"), (2, f"\t{shared}\r\nown line of document two\n{shared}"), (3, shared), (3, shared),
            (4, None), (5, ""), (6, "short\nshort\n"), (7, "short\n"), (None, f"{shared}\nnull one here"), (None, "null one here\nx"),
            (8, "Größe Élan ÀB und so\ngrößE élan Àb und so"), (9, "grösse\nGröße Élan ÀB UND SO"), (10, f"{shared}\n" * 30_000),
            (11, "unique line number\n" * 5), (12, "0123456789\n012345678"), (13, "0123456789\n012345678"), (14, f"x\n{shared}\n")]
    rows += [(100 + i, f"body {i} of its own\n{shared}") for i in range(40)]
    for max_docs in (1, 3):
        got = line_dedup.dedup_lines(frame(spark, rows), max_docs=max_docs)
        found = sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=repr)
        assert found == lines_by_hand(rows, max_docs=max_docs)
    assert all(sha(r["text"]) == r["kept_sha256"] for r in got.collect())
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(90, k) for k in range(100, 140)] + [(140, 139), (50, 50), (61, 60), (61, 62), (62, 60)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    want = {i: 0 for i in range(1, 31)} | {k: 90 for k in range(100, 141)} | {61: 60, 62: 60}
    rows = [tuple(r) for r in got.collect()]
    assert dict(rows) == want and Counter(i for i, _ in rows).most_common(1)[0][1] == 1
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0
