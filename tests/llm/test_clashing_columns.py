"""Documents whose columns have the names that the mixture and the row keys use themselves."""

from cohortlens.llm import mixing
from cohortlens.llm.common import ROW_KEY, Scratch, with_row_key

EXTRA = ["n", "size", "first", "blocks", "epoch", "uid", "words", "doc", "doc_key", "rank", "block", "_path", "_file", "_at", "_doc"]


def _documents(spark):
    rows = [(i if i % 5 else None, "word " * (i % 40 + 1) if i % 9 else None, f"s{i % 3}", *[f"{c}{i}" for c in EXTRA]) for i in range(60)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *EXTRA])


def test_mixed_texts_keep_columns_of_any_name(spark):
    docs = Scratch(spark).write(_documents(spark).repartition(3), "clash")
    got = mixing.mixed_texts(docs).collect()
    origin = {r["n"]: r for r in docs.collect()}
    assert len(got) >= 40
    for r in got:
        one = origin[r["n"]]
        assert r.asDict().keys() == one.asDict().keys()
        assert all(r[c] == one[c] for c in [*EXTRA, "doc_id", "source"])
        assert 0 < len(r["text"].split()) <= len(one["text"].split())
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_row_keys_keep_columns_of_any_name(spark):
    docs = Scratch(spark).write(_documents(spark).repartition(4), "clash")
    for table in (docs, _documents(spark)):
        keyed = with_row_key(table, Scratch(spark))
        assert keyed.columns == [*table.columns, ROW_KEY]
        rows = keyed.collect()
        assert len({r[ROW_KEY] for r in rows}) == len(rows) == 60
        assert sorted(r["n"] for r in rows) == sorted(r["n"] for r in table.collect())
