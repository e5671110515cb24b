import hashlib
import random

import numpy as np
import pytest

from shelfprice.llm import op04_repeats as rep


def brute(texts, length=400):
    data = [(x or "").encode() for x in texts]
    count = {}
    for b in data:
        for p in range(len(b) - length + 1):
            count[b[p:p + length]] = count.get(b[p:p + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), len(rep.runs_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    """Texts with copies, near copies, shared passages in other company, repeats of their own and periodic runs."""
    pick = random.Random(seed)

    def some(size):
        return "".join(pick.choice("abc de\né") for _ in range(size))

    passages = [some(s) for s in (399, 400, 401, 650, 1500)]
    texts = [None, "", "x" * 399, "y" * 2000, "ab" * 700, passages[3] + "é" + passages[3], passages[4]]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            texts.append(some(pick.randrange(50, 900)))
        elif kind == 1:
            texts.append(some(pick.randrange(300)) + pick.choice(passages) + some(pick.randrange(300)))
        elif kind == 2:
            texts.append(pick.choice(texts))
        elif kind == 3:
            base = list(pick.choice(texts) or some(700))
            for _ in range(2):
                if base:
                    base[pick.randrange(len(base))] = "Z"
            texts.append("".join(base))
        else:
            texts.append(pick.choice(passages)[pick.randrange(100):] + pick.choice(passages))
    return texts


def digests(rows):
    return sorted((r.n_bytes, r.n_removed, len(r.runs), hashlib.sha256(r.kept).hexdigest()) for r in rows)


@pytest.mark.parametrize("fragments", [500, 2])
def test_equals_brute_force(documents, monkeypatch, fragments):
    # Two fragments a shard: nearly every anchor is spread over shards.
    monkeypatch.setattr(rep, "SHARD_FRAGMENTS", fragments)
    texts = corpus(fragments, 40)
    found = rep.removed(documents(enumerate(texts))).collect()
    assert digests(found) == sorted(brute(texts))


def test_rows_and_empty_table(documents):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(900))
    pairs = [(1, long), (1, long), (None, None), (2, "short")]
    found = rep.removed(documents(pairs)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("1", 900), ("1", 900), ("2", 0), ("None", 0)]
    assert rep.removed(documents([])).collect() == []


def test_suffix_order_and_common_prefixes():
    pick = random.Random(5)
    parts = ["".join(pick.choice("ab") for _ in range(n)).encode() for n in (500, 450, 400)]
    parts += [parts[0][20:], parts[1] + parts[1]]
    repeated, heads = rep.repeated_windows(parts)
    count = {}
    for b in parts:
        for p in range(len(b) - 399):
            count[b[p:p + 400]] = count.get(b[p:p + 400], 0) + 1
    for b, marks in zip(parts, repeated, strict=True):
        assert marks.tolist() == [count[b[p:p + 400]] > 1 for p in range(len(b) - 399)]
    assert sum(h.sum() for h in heads) == len(count)


def test_suffixes_leave_the_rounds_when_no_window_needs_them(monkeypatch):
    sorted_sizes = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **how: sorted_sizes.append(len(a)) or argsort(a, **how))
    pick = random.Random(9)
    part = "".join(pick.choice("abcdefgh ") for _ in range(401)).encode()
    repeated, heads = rep.repeated_windows([part] * 50)
    assert all(marks.all() for marks in repeated) and sum(h.sum() for h in heads) == 2
    # Seven rounds of 8 to 400 bytes; at its end a fragment of 401 bytes has two windows and 400 other suffixes.
    assert sorted_sizes == [50 * (402 - depth) for depth in (8, 16, 32, 64, 128, 256, 400)]
