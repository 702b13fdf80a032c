"""The language model against a plain version: counting in dictionaries, one weight at a time."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import langid
from cohortlens.llm.common import fraction_of

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def cells(text, order=3, log_size=15):
    code = [ord(c) for c in f" {text.lower()} "]
    out = {}
    for start in range(len(code)):
        h = 0
        for n in range(1, order + 1):
            if start + n > len(code):
                break
            h = ((h + code[start + n - 1]) * 0x9E3779B1 + n) & MASK
            cell = (((h ^ (h >> 15)) * 0x85EBCA77) & MASK) >> (32 - log_size)
            out[cell] = out.get(cell, 0) + 1
    return out


def softmax(z):
    top = max(z)
    e = [math.exp(v - top) for v in z]
    return [v / sum(e) for v in e]


def plain_scores(train, texts, epochs=4, calibration=0.2, alpha=0.5, beta=1.0, l1=0.05, l2=0.1):
    """(languages, probabilities of each text) from training rows (order, text, language)."""
    languages = sorted({lang for _, _, lang in train})
    counted = [(v, languages.index(lang), cells(t)) for v, t, lang in train]
    df = {}
    for _, _, found in counted:
        for c in found:
            df[c] = df.get(c, 0) + 1
    idf = lambda c: math.log((1 + len(train)) / (1 + df.get(c, 0))) + 1

    def weighed(found):
        x = {c: (1 + math.log(n)) * idf(c) for c, n in found.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {c: v / norm for c, v in x.items()}

    rows = sorted(((v, label, weighed(found)) for v, label, found in counted), key=lambda r: r[0])
    held = int(len(rows) * calibration)
    z, n = {}, {}

    def weight(c, k):
        if abs(z.get((c, k), 0.0)) <= l1:
            return 0.0
        return -(z[c, k] - math.copysign(l1, z[c, k])) / ((beta + math.sqrt(n[c, k])) / alpha + l2)

    for _ in range(epochs):
        for _, label, x in rows[held:]:
            old = {(c, k): weight(c, k) for c in x for k in range(len(languages))}
            p = softmax([sum(v * old[c, k] for c, v in x.items()) for k in range(len(languages))])
            for c, v in x.items():
                for k in range(len(languages)):
                    g = v * (p[k] - (k == label))
                    before = n.get((c, k), 0.0)
                    z[c, k] = z.get((c, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old[c, k]
                    n[c, k] = before + g * g
    logits = lambda x: [sum(v * weight(c, k) for c, v in x.items()) for k in range(len(languages))]
    checked = [(logits(x), label) for _, label, x in rows[:held]]

    def loss(t):
        return -sum(math.log(max(softmax([v / t for v in row])[label], 1e-12)) for row, label in checked)

    heat = min((math.exp(math.log(0.02) + i * math.log(1000) / 4000) for i in range(4001)), key=loss)
    return languages, [softmax([v / heat for v in logits(weighed(cells(t)))]) for t in texts]


def test_predictions_equal_the_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL AND length(text) BETWEEN 30 AND 1500").limit(90)
    docs = spark.createDataFrame(docs.select("doc_id", "text", "lang").collect())
    held_out = F.col("doc_id") % 3 == 0
    got = {r["doc_id"]: r for r in langid.identify(docs, held_out, per_language=100_000).collect()}
    order = fraction_of(F.col("doc_id").cast("string"), F.col("text"), seed=24)  # the default seed and one
    train = [(r["v"], r["text"], r["lang"]) for r in docs.where(~held_out & F.col("lang").isNotNull()).withColumn("v", order).collect()]
    everything = docs.collect()
    languages, plain = plain_scores(train, [r["text"] for r in everything])
    assert len(languages) >= 3 and len(train) > 40
    for row, p in zip(everything, plain):
        if not langid.has_letter(row["text"]):
            continue
        mine = got[row["doc_id"]]
        best = max(range(len(p)), key=p.__getitem__)
        assert mine["score"] == pytest.approx(p[best], abs=5e-3)
        if sorted(p)[-1] - sorted(p)[-2] > 0.02:
            assert mine["lang_pred"] == languages[best]
