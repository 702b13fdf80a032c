"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_of

UNKNOWN = "und"


@dataclass(frozen=True)
class NGrams:
    """Hashed character n-grams of orders 1 to ``order`` over lower-cased code points, in 2^``log_size`` cells."""

    order: int = 3
    log_size: int = 15
    step: int = 1 << 18

    @property
    def size(self) -> int:
        return 1 << self.log_size

    def cells(self, text: str) -> Iterator[np.ndarray]:
        """Cells of all n-grams, a bounded stretch of the text at a time."""
        text = f" {text.lower()} "
        for at in range(0, len(text), self.step):
            part = text[at : at + self.step + self.order - 1]
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
            h = np.zeros(len(code), np.uint32)
            for n in range(1, self.order + 1):
                # an n-gram belongs to the stretch it starts in
                m = min(self.step, len(text) - at, len(code) - n + 1)
                if m <= 0:
                    break
                h = (h[:m] + code[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1) + np.uint32(n)
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - self.log_size)

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(self.size, np.int64)
        for cells in self.cells(text):
            total += np.bincount(cells, minlength=self.size)
        return total

    def tf_idf(self, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Non-zero cells and their weights: 1 + log count, times idf, to unit length."""
        counts = self.counts(text)
        cells = np.flatnonzero(counts)
        values = (1.0 + np.log(counts[cells])) * idf[cells]
        norm = np.sqrt(values @ values)
        return cells, values / norm if norm else values


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def document_frequencies(texts: DataFrame, grams: NGrams) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many each cell occurs, over every row of ``texts`` (one column, no null).

    Each task adds up its own texts; the sums of fixed size are added by about sqrt(tasks) tasks and
    then by one, which hold one sum at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(grams.size, np.int64)
        seen = np.zeros(grams.size, bool)
        for batch in batches:
            for text in batch.column(0):
                seen[:] = False
                for cells in grams.cells(text.as_py()):
                    seen[cells] = True
                total += seen
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()])], names=["n", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(grams.size, np.int64)
        for batch in batches:
            for k, df in zip(batch.column(0).to_pylist(), batch.column(1)):
                n += k
                total += np.frombuffer(df.as_buffer(), np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()])], names=["n", "df"])

    schema = "n long, df binary"
    parts = texts.mapInArrow(count, schema)
    parts = parts.repartition(16).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).collect()
    if not parts:
        return 0, np.zeros(grams.size, np.int64)
    return parts[0]["n"], np.frombuffer(bytes(parts[0]["df"]), np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic loss with L1 and L2 penalties.

    Per weight it keeps the adjusted gradient sum z and the squared gradient sum n; the weight is 0 while
    |z| <= l1, so the model stays sparse.
    """

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, cells) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p
        n = self.n[cells]
        self.z[cells] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cells] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high = np.log(0.02), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) <= loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    grams: NGrams
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        cells, values = self.grams.tf_idf(text, self.idf)
        return softmax(values.astype(np.float32) @ self.weights[cells] / self.temperature)


def train(
    labelled: DataFrame, grams: NGrams = NGrams(), per_language: int = 1000, epochs: int = 4,
    calibration: float = 0.2, seed: int = 23,
) -> LanguageModel:
    """Fit a model on ``labelled`` (id, text, lang; text and lang not null).

    Document frequencies come from all rows.  The weights are fitted on a sample of about ``per_language`` rows for
    every language (the documented bound), drawn by a hash of identifier and text, so rows that share an identifier or
    have none are drawn one by one; one in five of them only sets the temperature.
    The fit runs in one task over that bounded sample; ties in the sample's order go by text.
    """
    total, df = document_frequencies(labelled.select("text"), grams)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    found = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return LanguageModel(grams, [], idf, np.zeros((grams.size, 0), np.float32), 1.0)
    rates = {r["lang"]: per_language / r["count"] for r in found}
    rate = F.element_at(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    row = [F.col("id").cast("string"), F.col("text")]
    sample = labelled.withColumn("u", fraction_of(*row, seed=seed)).where(F.col("u") < rate)
    sample = sample.withColumn("v", fraction_of(*row, seed=seed + 1)).select("v", "text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [grams.tf_idf(t.as_py(), idf) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([c.astype("<u4").tobytes() for c, _ in pairs], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary())], names=["v", "lang", "cells", "weights"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for v, lang, cells, values in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.append((v, languages.index(lang), np.frombuffer(cells, "<u4"), np.frombuffer(values, "<f4").astype(float)))
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
        held = int(len(rows) * calibration)
        model = Ftrl(grams.size, len(languages))
        for _ in range(epochs):
            for _, label, cells, values in rows[held:]:
                model.learn(cells, values, label)
        weights = model.weights(slice(None)).astype(np.float32)
        check = rows[:held]
        heat = 1.0
        if check:
            logits = np.array([values @ weights[cells] for _, _, cells, values in check])
            heat = temperature(logits, np.array([label for _, label, _, _ in check]))
        yield pa.RecordBatch.from_arrays([pa.array([heat]), pa.array([weights.tobytes()], pa.binary())], names=["heat", "weights"])

    kinds = "v double, lang string, cells binary, weights binary"
    fitted = sample.mapInArrow(features, kinds).repartition(1).mapInArrow(fit, "heat double, weights binary").collect()
    shape = (grams.size, len(languages))
    weights = np.frombuffer(bytes(fitted[0]["weights"]), np.float32).reshape(shape) if fitted else np.zeros(shape, np.float32)
    return LanguageModel(grams, languages, idf, weights, fitted[0]["heat"] if fitted else 1.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row from its whole text alone.

    Null texts and texts without a letter get ``und`` with score 0; so does every text when nothing could be learned.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1):
                text = t.as_py()
                if not model.languages or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.scores(text)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """Train on the rows outside ``held_out`` that have a text and a language, and predict every row.

    ``held_out`` is a condition on the documents.  Returns doc_id, held_out, lang_pred, score.  Repeated rows
    count as often as they occur; a null identifier is an ordinary value; an empty table gives no rows;
    other columns are ignored.
    """
    known = docs.where(~held_out & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(labelled, **options)
    marked = docs.select(F.struct(F.col(id_col).alias("doc_id"), held_out.alias("held_out")).alias("who"), F.col(text_col).alias("text"))
    return predict(marked, model, "who", "text").select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")
