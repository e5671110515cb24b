import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfprice.llm import op11_lexical as lexical

ITEMS = "item_id long, text string, score int, terms string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    bags = [(i, Counter(terms(x)), len(terms(x))) for i, x in docs]
    bags = [b for b in bags if b[2]]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "été", "naïve x", "你好", "7up", "A1"]

    def text(n):
        return "".join(pick.choice(words) + pick.choice(" ,.-_\n\t'()") for _ in range(n))

    docs = [(i, text(pick.randrange(1, 40))) for i in range(120)]
    # Classes: equal texts, equal bags in another order, and bags that differ only beyond the vocabulary.
    docs += [(200 + i, "w1 w2 w3 zz") for i in range(25)] + [(300 + i, "W3, w2; w1 yy") for i in range(5)]
    docs += [(400, None), (401, ""), (402, " ,;"), (None, "w1 w2 w3 zz"), (5, "w4 w4 w5"), (5, "w4 w4 w5"), (403, "w6 " * 3000)]
    items = [(i, text(8)) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w1 w1 w2"), (23, "w1 w1 w2"), (23, "w4"), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize(("vocabulary", "per_pass", "block", "k"), [(200_000, 50_000, 512, 10), (3, 50_000, 7, 10), (200_000, 20, 1, 3)])
def test_equals_brute_force(spark, documents, monkeypatch, corpus, vocabulary, per_pass, block, k):
    docs, items = corpus
    monkeypatch.setattr(lexical, "VOCABULARY_TERMS", vocabulary)
    monkeypatch.setattr(lexical, "PASS_TERMS", per_pass)
    monkeypatch.setattr(lexical, "BLOCK", block)
    bench = spark.createDataFrame([(i, x, 1, "t") for i, x in items], ITEMS)
    clashing = documents(docs).withColumns({"terms": F.lit("x"), "m": F.lit(1), "item_id": F.lit(9), "row": F.lit(2)})
    assert rows(lexical.ranked(clashing.repartition(5), bench, k)) == brute(docs, items, k)


def test_classes_hold_equal_vectors_and_few_members(spark):
    held = [(i, 25, ["a", "b"], [1, 2]) for i in range(300)] + [(500, 25, ["a", "b"], [2, 1]), (501, 26, ["a", "b"], [1, 2]), (None, 25, ["a", "b"], [1, 2])]
    made = lexical.classes(spark.createDataFrame(held, "key long, m long, terms array<string>, counts array<int>").repartition(6), 4).collect()
    assert sorted((r.m, r.counts, r.members) for r in made) == [(25, [1, 2], [0, 1, 2, 3]), (25, [2, 1], [500]), (26, [1, 2], [501])]


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_BYTES", 10)
    text = "alpha beta  gamma " * 50 + "x" * 100 + " omega"
    assert lexical.bag(text.encode(), None) == (152, [b"alpha", b"beta", b"gamma", b"omega", b"x" * 100], [50, 50, 50, 1, 1])


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "w1", 1, "t")], ITEMS)
    some = documents([(1, "w1 w2"), (2, "w2")])
    for docs, items in ((documents([]), bench), (some, bench.limit(0)), (documents([(1, None), (2, "")]), bench), (some, bench.withColumn("text", F.lit("none")))):
        out = lexical.ranked(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
