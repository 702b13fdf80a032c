"""Language identification and toxicity: held-out accuracy, model parts and odd rows."""

import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, who string, score double, label int, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 0.5, 1, 2) for i, t, g in rows], DOC)


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(30)] + [(i, "der schnelle braune fuchs und", "de") for i in range(30, 60)]
    rows += [(60, None, "en"), (61, "", "de"), (62, "12 34 !?", "en"), (63, "the fox " * 100_000, None), (64, "😀 und der fuchs", None),
             (None, "the dog", None), (1, "the quick brown fox and the dog", "en")]
    got = langid.identify(docs(spark, rows), held_out=F.lit(False)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert [by[i] for i in (60, 61, 62)] == [("und", 0.0)] * 3
    assert by[63][0] == by[None][0] == "en" and by[64][0] == "de"
    assert langid.identify(docs(spark, rows).limit(0), held_out=F.lit(False)).count() == 0
    unknown = langid.identify(docs(spark, [(1, "text", None)]), held_out=F.lit(False)).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("und", 0.0)


def test_ngram_counts_do_not_depend_on_the_stretch():
    text = "Ein Satz, ein zweiter Satz. " * 40
    assert (langid.NGrams(step=7).counts(text) == langid.NGrams().counts(text)).all()


def test_document_frequencies(spark):
    grams = langid.NGrams(order=2, log_size=6)
    texts = ["abc", "ab", "x", "", "abcabc"]
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), grams)
    assert n == 5 and df.tolist() == np.sum([grams.counts(t) > 0 for t in texts], axis=0).tolist()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 3))
    labels = np.array([rng.choice(3, p=langid.softmax(row)) for row in z])
    assert 0.8 < langid.temperature(z, labels) < 1.3
    assert 4 < langid.temperature(5 * z, labels) < 6.5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_against_distances():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(600)]
    terms = [toxicity.Term(w, k % 3 == 0, float(k), k % 4 % 3) for k, w in enumerate(["abcab", "bbacb", "cab", "aaaaaaa", "bc", "cabbage"])]
    automaton = toxicity.FuzzyLexicon(terms, max_states=50)
    for w in words:
        options = []
        for k, t in enumerate(terms):
            # a stem may be followed by anything: the best distance to a prefix of the word
            d = min(distance(t.text, w)) if t.stem else distance(t.text, w)[-1]
            if d <= t.errors:
                options.append((d, k))
        found = automaton.find(w)
        assert (found is None) == (not options), (w, found, options)
        if found:
            assert found[1] == min(options)[0] and (found[1], found[0]) in options


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, SF)
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").join(lang, "doc_id").collect()
    assert got.count() == 1000
    english = [r for r in rows if r["lang"] == "en"]
    assert sum(r["predicted"] != r["toxic"] for r in rows if r["toxic"] == 0) <= 3
    caught = [r["predicted"] for r in english if r["toxic"] == 1]
    assert np.mean(caught) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def plain_corpus():
    clean = ["the house by the lake is warm and bright today", "we walked along the river and talked about music", "bread and soup for lunch again"]
    rows = []
    for i in range(160):
        text = f"{clean[i % 3]} number {i}"
        rows.append((i, text + (" you worthless rascal you worthless rascal" if i % 4 == 0 else ""), "en"))
    return rows


def test_misspellings_and_quotation(spark):
    rows = plain_corpus()
    extra = [(1000, "you worthles rascal, really w0rthless", "en"), (1001, "the house by the lake", "en"), (1002, None, "en"), (1003, "", "en"),
             (None, "a worthless rascal you are", "en"), (1004, "rascal " * 200_000, "en"), (0, rows[0][1], "en")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "z") for i, _, _ in rows] + [(5, None, "z"), (7777, 1, "z"), (None, 1, "z")],
                                   "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows + extra), labels, held_out=F.lit(False), min_root=3.0).collect()}
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, None, 1004, 0, 1)] == [1, 0, 0, 0, 1, 1, 1, 0]
    words = 'she said "you are a worthless rascal" in the quote'.split()
    assert toxicity.context_weight(words, 5) < toxicity.context_weight("you are a worthless rascal indeed".split(), 3)


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(docs(spark, [(1, "a b", "en")]), labels, held_out=F.lit(False)).collect()
    assert [(r["score"], r["predicted"]) for r in out] == [(0.0, 0)]
    assert toxicity.toxicity(docs(spark, []), labels, held_out=F.lit(False)).count() == 0


def test_logistic_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    assert np.abs(toxicity.fit_logistic(x, y, np.ones(4000)) - [0.5, 1, -2]).max() < 0.2
    assert math.isfinite(toxicity.root_g(3, 0, 10, 20, math.log)[0])
    assert list(itertools.islice(langid.NGrams().cells(""), 1))


def test_ftrl_is_sparse():
    zeros = []
    for l1 in (0.0, 2.0):
        model = langid.Ftrl(50, 2, l1=l1)
        rng = np.random.default_rng(4)
        for _ in range(500):
            label = int(rng.integers(2))
            cells = np.array([label, *rng.choice(np.arange(2, 50), 3, replace=False)])
            model.learn(cells, np.full(4, 0.5), label)
        w = model.weights(slice(None))
        assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0
        zeros.append((w[2:] == 0).mean())
    assert zeros[0] < 0.1 and zeros[1] > 0.5
