"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows around the hits."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fraction_of

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
QUOTES = "\"“”„«»‹›"
#: Words that report or mention what others say, and words that turn to a person.
REPORTING = frozenset("said says wrote writes called quoted quote term word words insult slur mot dit wort sagte palabra dijo".split())
ADDRESSING = frozenset("you your youre you're u are tu vous toi es du dich ihr eres usted ustedes".split())


@dataclass(frozen=True)
class Term:
    """A lexicon entry: a whole word, or a stem that any ending may follow; ``errors`` is the distance it tolerates."""

    text: str
    stem: bool
    weight: float
    errors: int


class FuzzyLexicon:
    """All words within each term's distance of the lexicon, as one lazily determinised automaton.

    A state is a set of (trie node, errors so far): the Levenshtein automaton of the word read so far, run against
    all terms of the trie at once.  Reading a letter matches it, substitutes it or takes it as an insertion;
    letters missing from the word are skipped in the trie.  States and their transitions are kept once computed, so
    a word costs one lookup a letter, and ends as soon as no term can be reached.  At most ``max_states`` are kept.
    """

    def __init__(self, terms: list[Term], max_states: int = 20_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        for t, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], term.errors)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], term.errors)
            (self.stem if term.stem else self.whole)[node] = t
        self._start()

    def _start(self) -> None:
        self.sets: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int]] = []  # best whole term and its errors
        self.stems: list[tuple[int, int]] = []
        self.first = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # letters missing from the word
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            for table, into in ((self.whole, self.ends), (self.stem, self.stems)):
                best = [(e, -self.terms[table[n]].weight, table[n]) for n, e in key if table[n] >= 0 and e <= self.terms[table[n]].errors]
                into.append((min(best)[2], min(best)[0]) if best else (-1, 0))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < nodes.get(node, 99):
                nodes[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        return self._state(nodes) if nodes else -1

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the closest term; a whole word before a stem at the same distance."""
        if len(self.sets) > self.max_states:
            self._start()
        state, best = self.first, None
        for c in word:
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if state < 0:
                break
            if self.stems[state][0] >= 0 and (best is None or self.stems[state][1] < best[1]):
                best = self.stems[state]
        if state >= 0 and self.ends[state][0] >= 0 and (best is None or self.ends[state][1] <= best[1]):
            best = self.ends[state]
        return best


class Lexicon:
    """Looks words up: exact terms first, then stems (longest first), then terms within their distance."""

    def __init__(self, terms: list[Term], max_words: int = 200_000):
        self.terms, self.max_words = terms, max_words
        self.whole = {t.text: i for i, t in enumerate(terms) if not t.stem}
        self.stems = {t.text: i for i, t in enumerate(terms) if t.stem}
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.fuzzy = FuzzyLexicon(terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def _find(self, word: str) -> tuple[int, int] | None:
        word = EDGES.sub("", word)
        if word in self.whole:
            return self.whole[word], 0
        for size in self.sizes:
            if word[:size] in self.stems:
                return self.stems[word[:size]], 0
        return self.fuzzy.find(word) if 3 <= len(word) <= 40 else None

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(position, term, errors) of the words found."""
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self._find(w)
        found = []
        for i, hit in enumerate(map(known.__getitem__, words)):
            if hit:
                found.append((i, *hit))
        return found


def context_weight(words: list[str], at: int, window: int = 6) -> float:
    """How far a hit speaks for itself: 1 in plain use, less inside quotation marks or after reporting words,
    more (up to 1.5) when the window turns to a person."""
    left, right = words[max(0, at - window) : at], words[at + 1 : at + 1 + window]
    before = sum(w.count(q) for w in left for q in QUOTES) + sum(words[at][:1].count(q) for q in QUOTES)
    after = sum(w.count(q) for w in right for q in QUOTES) + sum(words[at][-1:].count(q) for q in QUOTES)
    near = {EDGES.sub("", w) for w in left + right}
    weight = 1.0
    if before and after:
        weight *= 0.4
    if near & REPORTING:
        weight *= 0.6
    if near & ADDRESSING:
        weight *= 1.5
    return weight


FEATURES = 9


@dataclass
class DocumentHits:
    """Hits of one document, added up by term."""

    words: int
    exact: dict[int, float] = field(default_factory=dict)
    fuzzy: dict[int, float] = field(default_factory=dict)
    quoted: float = 0.0


def document_hits(text: str | None, lexicon: Lexicon) -> DocumentHits:
    words = (text or "").lower().split()
    out = DocumentHits(len(words))
    for at, term, errors in lexicon.hits(words):
        weight = context_weight(words, at)
        out.quoted += weight < 0.7
        into = out.fuzzy if errors else out.exact
        into[term] = into.get(term, 0.0) + weight * 0.8**errors
    return out


def features(h: DocumentHits, terms: list[Term]) -> list[float]:
    counts = Counter(h.exact)
    counts.update(h.fuzzy)
    total = sum(c * terms[t].weight / 8.0 for t, c in counts.items())  # a doubtful term counts for less
    rate = math.log1p(1000 * total / max(1, h.words))
    return [
        math.log1p(total),
        rate,
        rate * rate,
        max((terms[t].weight for t in counts), default=0.0),
        max((terms[t].weight * min(1.0, c / 3) for t, c in counts.items()), default=0.0),
        min(30.0, sum(terms[t].weight * math.log1p(c) for t, c in counts.items())),
        math.log1p(len(counts)),
        math.log1p(h.words) * (total > 0),
        math.log1p(h.quoted),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps; coefficients for raw features, intercept first."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float(w @ (np.logaddexp(0, m) - y * m) + 0.5 * penalty @ (b * b))

    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (w * (p - y)) + penalty * b
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-6 and loss(b - scale * step) > loss(b):
            scale /= 2
        b = b - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    slope = b[1:] / sd
    return np.concatenate([[b[0] - slope @ mean], slope])


def root_g(p, n, pos, neg, log):
    """Root of the likelihood ratio of a term held by p of pos and n of neg documents; negative if it is commoner in neg."""
    share = (p + n + 1.0) / (pos + neg + 2.0)
    a, b = (p + 0.5) / (pos + 1.0), (n + 0.5) / (neg + 1.0)
    g = p * log(a / share) + (pos - p) * log((1.0 - a) / (1.0 - share))
    g = g + n * log(b / share) + (neg - n) * log((1.0 - b) / (1.0 - share))
    return g * 2.0, a - b


COUNTS = [f"{kind}{f}" for kind in ("n", "p", "dense_n", "dense_p") for f in (0, 1)]


def candidate_counts(sample: DataFrame, min_docs: int, max_candidates: int) -> list:
    """Words and stems of the sample with the documents that hold them, by fold and label, and those that hold them
    densely (twice at least, and in 4 of 1000 words); the most telling candidates by likelihood ratio.

    Tasks count their own texts, Spark adds the counts up and keeps ``max_candidates``, so the driver's share is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for fold, label, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = Counter((text or "").lower().split())
                size = sum(words.values())
                found: Counter = Counter()
                for raw, k in words.items():
                    word = EDGES.sub("", raw)
                    if 3 <= len(word) <= 40:
                        found[word] += k
                        for j in range(3, min(9, len(word))):
                            found[word[:j] + "*"] += k
                for term, k in found.items():
                    row = total.setdefault(term, [0] * 8)
                    row[2 * label + fold] += 1
                    if k >= 2 and 1000 * k >= 4 * size:
                        row[4 + 2 * label + fold] += 1
        if total:
            columns = [pa.array(list(total), pa.string())]
            columns += [pa.array([v[i] for v in total.values()], pa.int64()) for i in range(8)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", *COUNTS])

    counted = sample.select("fold", "label", "text").mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    sizes = sample.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    pos, neg = sizes["p"] or 0, sizes["n"] - (sizes["p"] or 0)
    for kind in ("", "dense_"):
        p, n = F.col(f"{kind}p0") + F.col(f"{kind}p1"), F.col(f"{kind}n0") + F.col(f"{kind}n1")
        g, more = root_g(p, n, float(pos), float(neg), F.log)
        counted = counted.withColumn(f"{kind}g", F.when(more > 0, g).otherwise(0.0))
    kept = counted.where(F.col("p0") + F.col("p1") >= min_docs).withColumn("best", F.greatest("g", "dense_g"))
    return kept.orderBy(F.desc("best"), "term").limit(max_candidates).collect()


def choose_terms(rows: list, folds: tuple[int, ...], sizes: dict, max_terms: int, min_root: float, min_docs: int, min_odds: float = 3.0) -> list[Term]:
    """The lexicon from the counts of some folds: by likelihood ratio, with log odds of ``min_odds`` at least, and without
    entries that another one already covers."""
    pos = sum(sizes.get((f, 1), 0) for f in folds)
    neg = sum(sizes.get((f, 0), 0) for f in folds)
    if not pos or not neg:
        return []
    scored = []
    for r in rows:
        best = []
        for kind in ("", "dense_"):
            p, n = sum(r[f"{kind}p{f}"] for f in folds), sum(r[f"{kind}n{f}"] for f in folds)
            g, more = root_g(p, n, pos, neg, math.log)
            if p >= min_docs and more > 0 and g >= min_root**2:
                best.append((g, math.log((p + 0.5) / (pos - p + 0.5)) - math.log((n + 0.5) / (neg - n + 0.5))))
        if best and max(o for _, o in best) >= min_odds:
            stem = r["term"].endswith("*")
            text = r["term"][:-1] if stem else r["term"]
            held = sum(r[f"p{f}"] for f in folds)
            odds = min(8.0, max(o for _, o in best))
            # strong evidence, and among nested entries the one that clean texts do not share
            scored.append((-round(max(best)[0] * odds, 6), stem, -len(text), text, odds, held))
    terms: list[Term] = []
    taken: dict[str, int] = {}
    for _, stem, _, text, odds, held in sorted(scored):
        covered = any(t.stem and text.startswith(t.text) for t in terms)
        covered |= stem and any(t.text.startswith(text) and held <= 1.5 * taken[t.text] for t in terms)
        if not covered:
            errors = 0 if len(text) < 5 else 1 if len(text) < 9 else 2
            terms.append(Term(text, stem, odds, errors))
            taken[text] = held
            if len(terms) == max_terms:
                break
    return terms


@dataclass
class ToxicityModel:
    terms: list[Term]
    coefficients: np.ndarray
    base: float = 0.0

    def scorer(self):
        lexicon = Lexicon(self.terms)

        def score(text: str | None) -> float:
            if not self.terms:
                return self.base
            m = self.coefficients[0] + float(self.coefficients[1:] @ np.array(features(document_hits(text, lexicon), self.terms)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))

        return score


def train(
    labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = 4000,
    max_terms: int = 500, max_candidates: int = 20_000, min_docs: int = 4, min_root: float = 4.5, seed: int = 31,
) -> ToxicityModel:
    """Fit on ``labelled`` (id, label 0 or 1), on about ``per_label`` rows of each label (the documented bound), drawn by a
    hash of the identifier; an identifier labelled twice takes the higher label.

    The lexicon comes from document counts of words and stems.  The weights of the features come from hits
    of lexicons learned on the other half of the sample, so a word that was toxic by chance gains nothing, and
    rows are weighed back to the share of their label.  Terms whose misspellings turn up in more than 0.2 % of the
    clean documents of the sample lose their tolerance.
    """
    scratch = Scratch(docs.sparkSession)
    known = labelled.where("label IN (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    known = scratch.write(known, "labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel([], np.zeros(FEATURES + 1), float(counts.get(1, 0) > 0))
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, per_label / counts[1]))).otherwise(F.lit(min(1.0, per_label / counts[0])))
    chosen = known.withColumn("rate", rate).where(fraction_of(F.col("id").cast("string"), seed=seed) < F.col("rate"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fold = (fraction_of(F.col("id").cast("string"), seed=seed + 1) < 0.5).cast("int")
    # the sample's size is bounded above, so its identifiers may go to every task
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", "rate", fold.alias("fold"), "text")
    sample = scratch.write(sample, "sample")
    sizes = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    rows = candidate_counts(sample.repartition(16, "id"), min_docs, max_candidates)
    lexicons = {f: choose_terms(rows, (1 - f,), sizes, max_terms, min_root, min_docs) for f in (0, 1)}
    final = choose_terms(rows, (0, 1), sizes, max_terms, min_root, min_docs)

    def collect_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: Lexicon(lexicons[f]) for f in (0, 1)}
        whole = Lexicon(final)
        for batch in batches:
            x, fuzzy = [], []
            for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x.append(features(document_hits(text, own[f]), lexicons[f]))
                fuzzy.append(sorted(document_hits(text, whole).fuzzy))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64())), pa.array(fuzzy, pa.list_(pa.int64()))],
                names=["label", "rate", "x", "fuzzy"],
            )

    got = sample.repartition(16, "id").select("fold", "text", "label", "rate").mapInArrow(
        collect_hits, "label int, rate double, x array<double>, fuzzy array<long>"
    ).collect()
    if not got:
        return ToxicityModel([], np.zeros(FEATURES + 1), 0.0)
    got.sort(key=lambda r: (r["label"], r["rate"], r["x"]))
    y = np.array([r["label"] for r in got], float)
    weight = np.array([1 / r["rate"] for r in got])
    coefficients = fit_logistic(np.array([r["x"] for r in got]), y, weight / weight.mean())
    clean = Counter()
    for r in got:
        if not r["label"]:
            clean.update(r["fuzzy"])
    negatives = max(1, int((y == 0).sum()))
    terms = [
        Term(t.text, t.stem, t.weight, t.errors if clean[i] <= 0.002 * negatives else 0) for i, t in enumerate(final)
    ]
    return ToxicityModel(terms, coefficients)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 for the column ``text_col`` alone, over whole texts: (id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["who", "score"])

    rows = docs.select(F.col(id_col).alias("who"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"who {rows.schema['who'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", label_col: str = "toxic", **options) -> DataFrame:
    """Train on the labels outside ``held_out`` (a condition on the identifier) and score every document.

    Returns doc_id, held_out, score, predicted (1 from 0.5).  Null and empty texts hold no hit and get the score of
    a text without hits.  Labels other than 0 and 1, null labels and labels of unknown documents are ignored;
    without labels of both kinds the score is constant.  Repeated rows are scored alike; an empty table gives no
    rows; other columns are ignored.
    """
    known = labels.select(F.col(label_id).alias(id_col), F.col(label_col).alias("label")).where(~held_out)
    model = train(known.withColumnRenamed(id_col, "id"), docs.where(~held_out), id_col, text_col, **options)
    who = F.struct(F.col(id_col).alias("doc_id"), held_out.alias("held_out")).alias("who")
    scored = score(docs.select(who, F.col(text_col).alias("text")), model, "who", "text")
    return scored.select("who.doc_id", "who.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                    label_id: str = "doc_id", label_col: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``; one pass over the texts, no shuffle of them.

    Trained as in ``toxicity``.
    """
    known = labels.select(F.col(label_id).alias(id_col), F.col(label_col).alias("label")).where(~held_out)
    model = train(known.withColumnRenamed(id_col, "id"), docs.where(~held_out), id_col, text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            keep = [scorer(t.as_py()) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
