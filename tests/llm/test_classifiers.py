import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfprice.llm import op01_toxicity as tox
from shelfprice.llm import op06_quality as qua
from shelfprice.llm import op09_language as lang
from shelfprice.llm.common import fold, labelled_sample

LABELS = "doc_id long, quality int, toxic int, text string, score double"


@pytest.fixture(scope="module")
def labelled(spark, documents, prose):
    """Documents and labels: junk has symbols after every word, toxic ones an insult or a word of an own stem."""
    pick, pairs, labels = random.Random(2), [], []
    for i in range(240):
        words = prose(1000 + i, 40 + i % 60).split()
        good, toxic = int(i % 4 > 0), int(i % 5 == 0)
        if toxic:
            words[i % 30] = "you are an idiot." if i % 10 == 0 else "zorgh" + pick.choice(["a", "be", "cid"])
        if not good:
            words = [w + "###" for w in words]
        pairs.append((i, " ".join(words)))
        labels.append((i, good, toxic, None, None))
    pairs += [(1000, None), (1001, ""), (None, "null key"), (5, pairs[5][1])]
    labels += [(None, 1, 1, None, None), (3, None, None, None, None), (7, 1 - labels[7][1], labels[7][2], None, None)]
    return documents(pairs), spark.createDataFrame(labels, LABELS), pairs


def accuracy(scores, docs, labels, label, least):
    joined = scores.join(labels.select("doc_id", label), "doc_id").filter((F.col("doc_id") != 7) & F.col(label).isNotNull())
    return joined.agg(F.avg(((F.col("score") >= least).cast("int") == F.col(label)).cast("int"))).first()[0]


def test_folds_equal_crc32(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 7, 123456789, None]], "doc_id long").select("doc_id", fold("doc_id", 4).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 4 if r.doc_id is not None else 0 for r in rows]


def test_sample_is_bounded_and_labels_vote(labelled):
    docs, labels, _ = labelled
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "quality", F.lit(True), 50).collect()
    assert len({r.doc_id for r in rows}) == 50
    voted = {r.doc_id: r._y for r in labelled_sample(docs.select("doc_id", "text"), labels, "quality", F.lit(True), 1000).collect()}
    assert voted[7] == 1 and None not in voted


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, pairs = labelled
    held_out = fold("doc_id", 4) == 2
    scores = tox.scored(docs, tox.train(docs, labels, ~held_out))
    assert scores.count() == len(pairs)
    assert accuracy(scores.filter(held_out), docs, labels, "toxic", tox.THRESHOLD) > 0.9
    assert all(0 <= r.score < tox.THRESHOLD for r in scores.filter("doc_id >= 1000").collect())


def test_grammar_reads_clauses():
    grammar = tox.Grammar({})

    def kinds(text):
        return {k for k in range(tox.KINDS) if grammar.matches(text)[k]}

    assert kinds("A calm text.") == set() == kinds("")
    assert kinds("Some idiot came") == {0}
    assert kinds("you are an idiot") == {1} == kinds("idiot, that is what you are")
    assert kinds("He is not an idiot") == {3}
    assert kinds("They said he is an idiot") == {5}
    assert kinds("They said so. He is an idiot") == {1}
    assert kinds("I will kill you") == {9}
    assert grammar.matches("idiot idiot. idiot")[0] == 3 * tox.SEED_WEIGHT


def test_prior_orders_the_kinds():
    model = tox.Model({}, *tox.prior())
    score = lambda text: model.score(tox.Grammar({}).matches(text))
    assert score("you idiot") > score("an idiot") > score("they said he is an idiot") > score("fine")


def test_toxicity_without_labels_or_rows(documents, labelled):
    docs, labels, _ = labelled
    model = tox.train(docs, labels.limit(0), F.lit(True))
    assert model.lexicon == {}
    assert tox.scored(documents([]), model).collect() == []


def test_quality_on_held_out_rows(labelled):
    docs, labels, pairs = labelled
    held_out = fold("doc_id", 3) == 1
    scores = qua.scored(docs, qua.train(docs, labels, ~held_out), ["doc_id"])
    assert scores.count() == len(pairs)
    assert accuracy(scores.filter(held_out), docs, labels, "quality", qua.THRESHOLD) > 0.95
    assert all(0 <= r.score <= 1 for r in scores.collect())


def test_sum_of_squares_identity():
    import numpy as np

    pick = np.random.default_rng(0)
    size = qua.WORD_BUCKETS + 2 * (qua.BINS + 1)
    machine = qua.Machine(np.zeros((2, qua.BINS - 1)), 0.3, pick.normal(size=size) / 9, pick.normal(size=(size, qua.RANK)) / 9)
    buckets, values = np.array([3, 70, 900]), np.array([0.5, np.nan])
    at = np.concatenate([buckets, machine.columns(values)])
    x = qua.weights(3, 2)
    z = machine.bias + sum(machine.linear[i] * w for i, w in zip(at, x, strict=True))
    z += sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(5) for j in range(i + 1, 5))
    assert machine.score(buckets, values) == pytest.approx(1 / (1 + np.exp(-z)))
    assert machine.columns(values)[1] == size - 1


def test_quality_without_labels_keeps_everything(documents, labelled):
    docs, labels, _ = labelled
    machine = qua.train(docs, labels.limit(0), F.lit(True))
    assert qua.scored(docs, machine, ["doc_id"]).filter(f"score < {qua.THRESHOLD}").isEmpty()
    assert qua.scored(documents([]), machine, ["doc_id"]).collect() == []


TEXTS = {
    "en": "the house stands near the river and the people there walk with their dogs through the woods every evening",
    "de": "das haus steht nahe am fluss und die leute gehen dort jeden abend mit ihren hunden durch den wald spazieren",
    "fr": "la maison est près de la rivière et les gens se promènent chaque soir avec leurs chiens dans la forêt",
}


def test_languages(spark):
    words = {k: v.split() for k, v in TEXTS.items()}
    pick = random.Random(1)
    rows = [(i, " ".join(pick.sample(words[k], 12)), k) for i, k in enumerate(list(TEXTS) * 40)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "fr"), (503, "some text", None), (None, rows[0][1], "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = fold("doc_id", 3) == 1
    found = lang.languages(docs, lang.learn(docs, ~held_out))
    assert found.count() == len(rows)
    by_id = {r.doc_id: r for r in found.collect()}
    assert all(by_id[i].lang_pred == k and by_id[i].score > 0.9 for i, _, k in rows[:120])
    assert [by_id[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    mixed = spark.createDataFrame([(1, f"{TEXTS['en']} {TEXTS['en']} {TEXTS['de']}")], "doc_id long, text string")
    row = lang.languages(mixed, lang.learn(docs, F.lit(True))).first()
    assert [m.lang for m in row.mixture] == ["en", "de"] and 0.5 < row.score < 0.8


def test_languages_without_rows(spark, documents):
    empty = documents([])
    model = lang.learn(empty, F.lit(True))
    assert model[0] == []
    assert lang.languages(empty, model).collect() == []
    assert [r.lang_pred for r in lang.languages(documents([(1, "text")]), model).collect()] == ["und"]


def test_small_shares_of_long_texts_are_found():
    import numpy as np

    draw = np.random.default_rng(3)
    table = draw.dirichlet(np.full(lang.BUCKETS, 0.05), 4).T + 1e-9
    table /= table.sum(0)

    def text(*sizes):
        return np.concatenate([draw.choice(lang.BUCKETS, n, p=table[:, i]) for i, n in enumerate(sizes)])

    chosen, shares = lang.mixture(text(147_750, 0, 2_250, 0), table)
    assert chosen.tolist() == [0, 2] and abs(shares[1] - 0.015) < 0.003
    chosen, _ = lang.mixture(text(100_000, 0, 700, 300), table)
    assert chosen.tolist() == [0, 2, 3]
    # No language without a share earns its penalty.
    assert lang.mixture(text(0, 5_000, 0, 0), table)[0].tolist() == [1]


def plain_matches(text, lexicon):
    """Clauses, symbols and marks by looking around each word, without machines."""
    found, clause = [0.0] * 16, []
    closed = [(tox.THREATS, "threat"), (tox.REPORTS, "report"), (tox.NEGATIONS, "not"), (tox.TARGETS, "target")]
    for token in [*text.lower().split(), None]:
        if token is not None:
            clause.append(token)
            if not token.endswith(tox.ENDS):
                continue
        bare = [t.strip(tox.STRIPPED) for t in clause]
        kinds, weights = [], []
        for t, b in zip(clause, bare, strict=True):
            weight = max([lexicon.get(w, tox.SEED_WEIGHT * (w in tox.INSULTS)) for w in tox.LETTERS.findall(t)], default=0)
            kinds.append("insult" if weight else next((k for words, k in reversed(closed) if b in words), ""))
            weights.append(weight)
        for i in range(len(bare)):
            ends = [(i + len(p.split()) - 1, k) for k, listed in (("insult", tox.INSULT_PHRASES), ("threat", tox.THREAT_PHRASES)) for p in listed if bare[i:i + len(p.split())] == p.split()]
            if ends and kinds[max(ends)[0]] not in ("insult", "threat"):
                kinds[max(ends)[0]], weights[max(ends)[0]] = max(ends)[1], tox.SEED_WEIGHT
        for i, kind in enumerate(kinds):
            if kind in ("insult", "threat"):
                aimed = "target" in kinds[max(0, i - tox.TARGET_REACH):i] + kinds[i + 1:i + 1 + tox.TARGET_REACH]
                negated, reported = "not" in kinds[max(0, i - tox.NEGATION_REACH):i], "report" in kinds[:i]
                found[aimed + 2 * negated + 4 * reported + 8 * (kind == "threat")] += weights[i] if kind == "insult" else 1.0
        clause = []
    return found


def test_toxicity_equals_plain_matching():
    pick = random.Random(5)
    pool = "you he not never said wrote idiot zork trash kill burn a the house get lost watch your back piece of i will find shut up say. go! to hell; fine, \"stupid\"".split()
    grammar = tox.Grammar({"zork": 2.0})
    for _ in range(400):
        text = " ".join(pick.choice(pool) for _ in range(pick.randrange(1, 25)))
        assert grammar.matches(text).tolist() == pytest.approx(plain_matches(text, {"zork": 2.0})), text


def test_phrases_are_matched_as_wholes():
    grammar = tox.Grammar({})
    for text, kinds in (("Get lost, you!", {1}), ("get it lost", set()), ("She said: watch your back.", {9}), ("they said watch your back", {13}), ("don't ever shut up", {2}), ("lost", set())):
        assert set(grammar.matches(text).nonzero()[0].tolist()) == kinds, text


def test_mixtures_equal_a_plain_search():
    import itertools
    import math

    import numpy as np

    draw = np.random.default_rng(3)
    table = draw.dirichlet(np.full(lang.BUCKETS, 0.05), 3).T + 1e-9
    table /= table.sum(0)
    for sizes in ((300, 0, 0), (200, 180, 0), (40, 0, 260), (150, 150, 150), (5, 0, 0)):
        grams = np.concatenate([draw.choice(lang.BUCKETS, n, p=table[:, i]) for i, n in enumerate(sizes)])

        def likelihood(shares):
            return sum(math.log(sum(s * table[g, i] for i, s in shares.items())) for g in grams.tolist())

        best = None
        for size in (1, 2, 3):
            for chosen in itertools.combinations(range(3), size):
                shares = dict.fromkeys(chosen, 1 / size)
                for _ in range(lang.ROUNDS if size > 1 else 0):
                    held = {i: sum(shares[i] * table[g, i] / sum(shares[j] * table[g, j] for j in chosen) for g in grams.tolist()) for i in chosen}
                    shares = {i: x / len(grams) for i, x in held.items()}
                value = likelihood(shares) - size * lang.PENALTY * 0.5 * math.log(len(grams))
                if best is None or value > best[0]:
                    best = value, shares
        chosen, shares = lang.mixture(grams, table)
        assert {int(i): pytest.approx(float(s), abs=1e-6) for i, s in zip(chosen, shares)} == best[1]


def test_quality_scores_equal_all_pairs():
    import math

    import numpy as np

    draw = np.random.default_rng(4)
    statistics = 5
    rows = [(np.unique(draw.integers(0, 60, 30)), draw.normal(size=statistics), int(draw.random() < 0.5)) for _ in range(80)]
    machine = qua.fit(rows, statistics)
    for buckets, values, _ in rows[:20]:
        at = [*buckets.tolist(), *machine.columns(values).tolist()]
        x = [1 / math.sqrt(len(buckets))] * len(buckets) + [1.0] * statistics
        z = machine.bias + sum(machine.linear[i] * w for i, w in zip(at, x))
        z += sum(float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert machine.score(buckets, values) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
