import re

import pytest
from pyspark.sql import functions as F

from shelfprice.llm import op12_quality_rules as rules

CASES = [
    None, "", " \t\n\x0b\x0c\r ", "one", "the cat sat on the mat and the dog saw it all", "a b c d e a b c d e", "a b c d e f a b c d e f a b c d e",
    "x " * 40, "same line here\nsame line here\n\n  \nother\nsame line here", "same\r\nsame\n", "#hash* $1 %& <p>| plain word", "été naïve 你好 \U0001f600 the end of it",
    "no break stays one word", "- one\n* two\n1. three\n2) four\nplain", "wait...\nfor it…  \nnow", "p q r s t u v w p q r s t x q r s t u v",
]


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    m = {
        "one": 1, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered), "n_stop_words": sum(x in rules.stop_words() for x in w),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*([-*•]|[0-9]+[.)])[\x20\x09]", x)) for x in lines),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines),
    }
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    failed = [r.name for r in rules.RULES if m[r.whole] and not ((r.least or 0) * m[r.whole] <= 1000 * m[r.part] <= (float("inf") if r.most is None else r.most * m[r.whole]))]
    return {**m, "base_failed": base, "kept": not base and not failed, "failed_rules": failed}


def test_equals_brute_force(spark, documents):
    pairs = [(i, x) for i, x in enumerate([*CASES, *CASES[:6]])] + [(None, "the end"), (3, "one")]
    found = rules.judged(documents(pairs)).collect()
    assert len(found) == len(pairs)
    by_id = {(r.doc_id, r.text): r.asDict() for r in found}
    for key, text in pairs:
        got, want = by_id[key, text], brute(text)
        assert {k: got[k] for k in want if k != "one"} == {k: v for k, v in want.items() if k != "one"}, text
    assert {"node", "score", "text_key", "words", "lang"} <= set(found[0].asDict())


def test_very_long_and_repetitive_texts(documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    got = {r.doc_id: r for r in rules.judged(documents([(1, long + " " + long), (2, long), (3, "ab " * 60_000)])).collect()}
    assert [got[i].n_repeat_words for i in (1, 2, 3)] == [60_000, 0, 60_000]
    assert [got[i].base_failed for i in (1, 2, 3)] == [True, False, True]


def test_clashing_names_and_empty_tables(spark, documents):
    docs = documents([(1, "the end of it")]).withColumns({"kept": F.lit("x"), "row": F.lit(7), "_text": F.lit("y"), "_words": F.lit(1), "one": F.lit(2)})
    out = rules.judged(docs)
    assert len(out.columns) == len(set(out.columns))
    row = out.first()
    assert (row.kept, row.row, row._text, row._words, row.one, row.n_words) == (False, 7, "y", 1, 2, 4)
    assert rules.judged(docs.limit(0)).collect() == []


def test_one_projection_without_user_functions(documents, capsys):
    rules.judged(documents([(1, "a b")])).filter("kept").explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search(r"Exchange|EvalPython|InArrow|InPandas", plan)


@pytest.mark.parametrize(("least", "most", "kept"), [(None, None, True), (1000, None, True), (1001, None, False), (None, 1000, True), (None, 999, False)])
def test_bounds_are_inclusive(documents, least, most, kept):
    table = (rules.Rule("r", "n_words", "n_words", least, most),)
    assert rules.judged(documents([(1, "a b c d e f g h i j")]), table).first().kept is kept


def test_clean_prose_is_kept(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = rules.judged(docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id")).filter("not base_failed")
    assert good.filter("not kept").select("doc_id", "failed_rules").collect() == []
