"""SentencePiece ids, lexical search and phrase collocations against the library and plain counting."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import differences, duck

from cohortlens.llm import lexical, phrase_index, pieces, queries, sql
from cohortlens.llm.tokens import public_tokenizer

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizer("piece_bpe_32k.model")
LETTERS = ["a", "b", "e", "the ", " ", "  ", " " * 17, "\n", "\t", "\r", "▁", "é", "中", "👍", "<s>", "</s>", "<0x41>", "))",
           "\x00", "İ", "=", "-" * 9, "aaa", " ", " "]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def _ids(rows):
    return [np.array(r, "<u4").tobytes() for r in rows]


def test_pieces_are_those_of_the_library(model):
    draw = random.Random(3)
    texts = ["".join(draw.choices(LETTERS, k=draw.randint(0, 40))) for _ in range(4000)]
    texts += [" " * 2000 + "x", "a" * 1500, "ab" * 1000, "=-" * 400, "".join(draw.choices("abcdefgh", k=4000))]
    want = _ids(model.library.encode(texts))
    got = model.encode(texts)
    assert got == want
    assert model.encode(texts) == want  # from the cache
    assert model.decode(got) == [model.library.decode(np.frombuffer(r, "<u4").tolist()) for r in got]


def test_decoding_any_ids(model):
    draw = random.Random(4)
    rows = [[draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(260) for _ in range(draw.randint(0, 12))]
            for _ in range(3000)]
    assert model.decode(_ids(rows)) == [model.library.decode(r) for r in rows]


def test_encoded_table_keeps_rows_and_columns(spark, model):
    rows = [(1, "The cat", "x"), (1, "The cat", "x"), (None, None, "y"), (2, "", None), (3, "á " * 60_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert bytes(r["ids"]) == _ids([[1, *model.library.encode(r["text"] or ""), 2]])[0]
        assert r["decoded"] == (r["text"] or "")
    assert got.count() == 5
    assert pieces.encode_pieces(docs.limit(0), MODEL).count() == 0


def test_sentencepiece_query(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = [1, *model.library.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(_ids([ids])[0]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


# lexical search


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _best(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in _terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_size, block_bytes", [(4_000_000, 1 << 25), (40, 100)])
def test_search_is_exact(spark, shard_size, block_bytes):
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "B", "c3", "dé", "É", "f", "g h", "x", "Yy", "zz"]) * draw.choice([1, 1, 2])
    text = lambda n: draw.choice([" ", "-", "\r\n", "_"]).join(word() for _ in range(draw.randint(0, n)))
    docs = [(draw.randint(0, 60), text(30)) for _ in range(120)] + [(None, "a b zz"), (None, "a b zz"), (7, None), (8, "")]
    docs += [(100 + i, "f f x") for i in range(25)]  # ties
    items = [(i, text(12)) for i in range(15)] + [(50, None), (51, "nowhere"), (52, "f x x"), (52, "f"), (None, "a")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("n", "n")
    left = left.selectExpr("doc_id", "text", "1 AS item", "2 AS score").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = lexical.search(left, right, k=4, shard_size=shard_size, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _best(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("false"), items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_lexical_search"])
def test_query_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    result = duck(SF).execute(sql.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert differences(df.columns, [tuple(r) for r in df.collect()], columns, result.fetchall()) is None


# phrases


def _grams(text, size):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
        words = re.findall("[^ \t]+", piece)
        yield from (tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def test_index_extends_both_ways():
    draw = random.Random(6)
    words = [draw.choice("abcde") for _ in range(400)]
    text = "".join(w + draw.choice([" ", " ", " ", ". "]) for w in words).encode()
    vocabulary, symbols = phrase_index._symbols([phrase_index._cut([text])])
    index = phrase_index.PhraseIndex(*phrase_index.PhraseIndex.of(symbols, 3), len(vocabulary) + 1)
    names = [b""] + vocabulary.to_pylist()
    for turns in ([True, False, True], [False, False, False], [True, True, True], [False, True, False]):
        found = index.words()
        for size, right in enumerate(turns, start=2):
            found = index.extend(found, right)
            got = {tuple(names[w].decode() for w in row): int(n) for row, n in zip(found.words, found.size)}
            assert got == dict(Counter(_grams(text.decode(), size)))


@pytest.mark.parametrize("bits", [26, 8])
def test_frequent_phrases_count_everything(spark, bits):
    draw = random.Random(7)
    line = lambda: "".join(draw.choice(["A", "b", "c", "dé", "e\x00f"]) + draw.choice([" ", "\t ", ", ", "\r\n"]) for _ in range(25))
    rows = [(i % 3, line(), draw.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(None, None, "en"), (None, "", None), (9, "b " * 3000, "en"), (9, "b " * 3000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS f", "'x' AS phrase", "2 AS size")
    scratch = phrase_index.Scratch(spark)
    grams, totals = phrase_index.frequent_phrases(
        docs.repartition(3), scratch, max_words=4, min_count=5, shard_words=300, filter_bits=bits
    )
    want = {}
    for _, text, lang in rows:
        for size in (1, 2, 3, 4):
            want.setdefault(size, Counter()).update((lang or "und", " ".join(g)) for g in _grams(text, size))
    got = {(r["size"], r["lang"], r["phrase"]): r["f"] for r in grams.collect()}
    assert got == {(size, *key): n for size, found in want.items() for key, n in found.items() if n >= 5}
    n = Counter()
    for (lang, _), count in want[1].items():
        n[lang] += count
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)


def test_collocations_beyond_64_bits_and_of_nothing(spark):
    docs = spark.createDataFrame([("x y. " * 40_000, "en"), ("x z. " * 30, "en")], "text string, lang string")
    got = {r["phrase"]: r for r in phrase_index.collocations(docs).collect()}
    a, left, right = 40_000, 40_030, 40_000
    assert got["x y"]["score"] == 1_000_000 * a * a // (left * right)
    assert (got["x y"]["a"], got["x y"]["l"], got["x y"]["r"], got["x y"]["n"]) == (a, left, right, 80_060)
    assert phrase_index.collocations(docs.limit(0)).count() == 0
