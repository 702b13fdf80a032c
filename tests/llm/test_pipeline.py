"""The pipeline, stage by stage, against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
from test_near_duplicates import by_hand
from test_tokens_packing_mixing import check_packing, targets_by_hand

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm import mixing, queries
from cohortlens.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, outputs = [docs], []
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(scratch.write(stage(spark, inputs[-1], SF)))
        inputs.append(outputs[-1])
    assert [o.columns for o in outputs[:-1]] == [docs.columns] * 4
    toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, SF).collect() if r["predicted"]}
    all_rows = rows(docs)
    clean = [r for r in all_rows if r[0] not in toxic]
    assert sorted(rows(outputs[0])) == sorted(clean)

    groups = defaultdict(list)
    for r in clean:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    single = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    assert len(single) < len(clean)
    assert sorted(rows(outputs[1])) == sorted(single)

    kept = {i for i, _, _, stays in by_hand([(r[0], r[1]) for r in sorted(single)], 5) if stays}
    near = [r for r in single if r[0] in kept]
    assert len(near) < len(single)
    assert sorted(rows(outputs[2])) == sorted(near)

    check_mixed(near, rows(outputs[3]))
    texts = rows(outputs[3])
    numbered = [(k, r[1]) for k, r in enumerate(texts)]
    again = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in numbered], DOC)
    packed = corpus_pipeline.pack_sequences(spark, again, SF).collect()
    used, least = check_packing(packed, numbered, 1024)
    assert used <= 1.05 * least + 1
    assert sum(r["length"] for r in packed) == sum(r["length"] for r in outputs[4].collect())


def check_mixed(before, after):
    text, source = {r[0]: r[1] for r in before}, {r[0]: r[3] for r in before}
    got, times, whole = defaultdict(int), defaultdict(int), Counter()
    for doc_id, part, _, src, n in after:
        assert src == source[doc_id] and n == len(part)
        assert not Counter(words(part)) - Counter(words(text[doc_id]))
        got[src] += len(words(part))
        times[doc_id] += len(words(part))
        whole[doc_id] += part == text[doc_id]
    assert all(times[i] <= 3 * len(words(t)) for i, t in text.items()) and max(whole.values()) <= 3
    sizes = defaultdict(int)
    for r in before:
        sizes[r[3]] += len(words(r[1]))
    for s, target in targets_by_hand(sizes).items():
        assert abs(got[s] - target) <= 128 + 0.01 * target


def test_mixed_texts_of_odd_rows(spark):
    data = [(1, " a\tb  c ", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", None, 1), (4, "w" + " x" * 500, None, None, 1), (None, "k l", "en", "s", 1)]
    docs = spark.createDataFrame(data, DOC)
    out = rows(mixing.mixed_texts(docs, block=4, shard_blocks=16))
    assert {r[0] for r in out} <= {1, 4, None}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs, block=4, shard_blocks=16).collect()}
    for i in (1, 4, None):
        assert sum(len(words(r[1])) for r in out if r[0] == i) == taken[i]
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_run_and_registration(spark):
    names = set(entry.queries())
    assert {"pipeline"} | {f.__name__ for f in queries.queries().values()} <= names
    assert sum(bool(re.match(r"op\d+_", n)) for n in names) == 13
    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert out.count() > n / 2


def test_odd_rows_pass_all_stages(spark, tmp_path):
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", "a", 1), (None, "some words here", "en", "a", 1),
            (3, "some words here", "de", "b", 2), (4, "long " * 50_000, "en", "a", 3), (4, "other text", "en", "a", 3), (5, "w", "en", "é", 1)]
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (data, []):
        docs = spark.createDataFrame(table, DOC)
        for _, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark).write(stage(spark, docs, str(tmp_path)))
        assert (docs.count() > 0) == bool(table)
