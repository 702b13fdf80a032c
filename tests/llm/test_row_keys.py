"""One row of each group stays in the pipeline, whatever the identifiers say."""

from collections import Counter

import corpus_pipeline
from cohortlens.llm import mixing
from cohortlens.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))


def frame(spark, rows):
    data = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return Scratch(spark).write(spark.createDataFrame(data, DOC).repartition(3))


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())


def test_exact_copies_leave_one_row(spark):
    docs = frame(spark, [
        (1, "same text", "a"), (1, "same text", "a"), (1, "same text", "b"),  # repeated rows
        (None, "no name", "a"), (None, "no name", "a"), (None, "noname", "a"),  # copies without identifier
        (2, "x y", "a"), (2, "other", "a"), (3, "xy ", "a"), (3, "third", "a"),  # a copy beside a kept text of its identifier
    ])
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    # "x y" and "xy " are equally long: the smaller identifier stays
    assert [r[1:] for r in kept(out)] == [(1, "same text"), (2, "other"), (2, "x y"), (3, "third"), (0, "no name")]


def test_near_copies_leave_one_row(spark):
    near = LONG + " more"
    docs = frame(spark, [
        (1, LONG, "a"), (1, LONG, "a"), (2, near, "a"), (2, "a text of its own in this table", "a"),
        (None, "here is one text without any identifier at all", "a"), (None, "here is one text without any identifier at all", "a"),
    ])
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert [r[2] for r in kept(out)] == [
        LONG, "a text of its own in this table", "here is one text without any identifier at all"
    ]


def test_repeated_rows_are_drawn_as_planned(spark):
    repeated = [(7, LONG, "a")] * 5 + [(None, LONG, "b")] * 3
    docs = frame(spark, repeated + [(k, f"{k} " * (20 + k), "ab"[k % 2]) for k in range(10, 40)])
    want = Counter()
    for r in mixing.mix_documents(docs, block=4, shard_blocks=16).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_texts(docs, block=4, shard_blocks=16).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == want
