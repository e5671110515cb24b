import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from shelfprice.llm import op06_quality, op08_secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    pick, d = random.Random(8), str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(40 + i, 25)) for i in range(4)]
    texts = [prose(100 + i, 60 + i) for i in range(60)]
    texts += [" ".join(w + "$$$" for w in prose(300 + i, 50).split()) for i in range(25)]
    texts += [t + " end" for t in texts[:10]] + texts[10:15] + [f"{prose(500 + i, 30)} {items[i % 4][1]}" for i in range(8)]
    texts += [f"{prose(600, 40)} password=hunter2xyz {prose(601, 9)}", None, ""]
    rows = [(i, x, "en", "s", None if x is None else len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("$$$" not in (x or "")), 0) for i, x in enumerate(texts) if x and pick.random() < 0.8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, dict(items)


def expected(spark, folder):
    """The stages by brute force over the rows; the score is the machine's own."""
    d, rows, items = folder
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    machine = op06_quality.train(docs, labels, labels.doc_id.isNotNull())
    scores = {r.doc_id: r.score for r in op06_quality.scored(docs, machine, ["doc_id"]).collect()}
    left = [(i, x) for i, x, *_ in rows if scores[i] >= op06_quality.THRESHOLD]
    root = {i: i for i, _ in left}
    for _ in left:
        for i, x in left:
            for j, y in left:
                a, b = sets(x), sets(y)
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        break
    left = [(i, x) for i, x in left if root[i] == i]
    left = [(i, x) for i, x in left if not any(100 * len(sets(x) & sets(y)) >= 75 * len(sets(y)) for y in items.values())]
    out = {}
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    for i, x in left:
        for s in reversed(op08_secrets.scan(x or "")[1]):
            x = x[:s.start] + "[SECRET]" + x[s.end:]
        out[i] = library.encode(x or "", add_special_tokens=False).ids
    return out


def test_run_equals_brute_force(spark, folder):
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, folder[0]).collect()}
    assert found == expected(spark, folder)
    kept = set(found)
    assert {*range(10, 15)} <= kept and not kept & {*range(60, 85)} and not kept & {*range(100, 108)}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []
