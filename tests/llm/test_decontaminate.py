import random

import pytest

from shelfprice.llm import common
from shelfprice.llm import op10_decontaminate as dec


def sets(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, items):
    out = []
    for key, x in docs:
        for item, y in set(items):
            a, b = sets(x), sets(y)
            if b and 100 * len(a & b) >= 75 * len(b):
                out.append((str(key), str(item), len(a & b), len(b)))
    return sorted(out)


def corpus(prose):
    pick = random.Random(4)
    items = [(i, prose(300 + i, 4 + 3 * i)) for i in range(14)] + [(20, None), (21, ""), (22, "few words"), (1, prose(301, 7)), (23, prose(305, 19)), (None, prose(306, 22))]
    docs = [(0, None), (1, ""), (2, "Few  WORDS"), (3, "few words and more of them"), (4, prose(1, 300))]
    for i in range(40):
        item = (pick.choice(items)[1] or "").split()
        if item and pick.random() < 0.5:
            item[pick.randrange(len(item))] = "zz"
        cut = item[: len(item) - pick.randrange(5)]
        docs.append((i + 10, f"{prose(500 + i, pick.randrange(200))}\n{' '.join(cut).upper()} {prose(700 + i, 30)}"))
    return docs + [docs[10], (None, docs[11][1])], items


@pytest.mark.parametrize("rows", [200_000, 0])
def test_equals_brute_force(spark, documents, prose, monkeypatch, rows):
    # Without room for a broadcast every join goes through a shuffle.
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    docs, items = corpus(prose)
    table = spark.createDataFrame([(i, x, "k") for i, x in items], "item_id long, text string, text_key string")
    found = dec.contained_items(documents(docs), table).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_item) for r in found) == brute(docs, items)


def test_decontaminated_and_empty_tables(spark, documents, prose):
    docs, items = corpus(prose)
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(docs)
    left = dec.decontaminated(frame, table)
    leaked = {k for k, *_ in brute(docs, items)}
    assert left.columns == frame.columns
    assert {(r["_key"], r["_text_key"], r["row"], r["text_key"]) for r in left.collect()} == {("k", 8, 9, 7)}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, _ in docs if str(k) not in leaked)
    assert dec.contained_items(frame, table.limit(0)).collect() == []
    assert dec.contained_items(documents([]), table).collect() == []


def test_only_native_operations(spark, documents, prose):
    docs, items = corpus(prose)
    plan = dec.contained_items(documents(docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
