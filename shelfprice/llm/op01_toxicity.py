"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import fold, labelled_sample, map_batches, read_table, slices, stored

#: Labelled rows that lexicon and weights are learned from at most.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.3
#: Least share of toxic ones among the documents of a lexicon term; how often the lexicon looks at what it leaves unexplained.
LEAST_SHARE, ROUNDS = 0.6, 3
#: Stems count from this to that many letters, beside whole words.
STEM_LETTERS = range(3, 9)
#: Words that negation reaches, and words between an insult and whom it is aimed at.
NEGATION_REACH, TARGET_REACH = 3, 4
MEMO_TERMS, HELD_TERMS = 500_000, 300_000

# Symbols of the grammar's alphabet. INSULT is the first of those that can make a clause match.
OTHER, TARGET, NEGATION, REPORT, BREAK, INSULT, THREAT = range(7)

# Closed word classes of English, German, French and Spanish, and a seed of insults and threats.
TARGETS = "you your yours yourself u he him she her they them this that these those du dich dir dein ihr euch sie er diese dieser tu te toi vous il elle ils ce cette tú ti usted ustedes él ella ellos este esta".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say told wrote writes called calls quoted quotes claimed claims reported reportedly allegedly sagte sagt schrieb nannte dit écrit appelle selon dijo dice escribió llamó según".split()
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile dumb vermin filth".split()
THREATS = "kill hurt murder destroy strangle stab shoot burn töten umbringen tuer matar".split()
INSULT_PHRASES = [
    "piece of trash", "piece of garbage", "waste of space", "waste of oxygen", "good for nothing", "shut up", "get lost", "drop dead", "go to hell",
    "halt die klappe", "fahr zur hölle", "ferme la", "va en enfer", "cállate la boca", "vete al infierno",
]
THREAT_PHRASES = [
    "watch your back", "you will regret", "you'll regret", "i will find you", "i'll find you", "you will pay", "you'll pay", "coming for you", "you are dead", "you're dead",
    "ich finde dich", "du wirst bezahlen", "je te retrouverai", "tu vas payer", "te voy a encontrar", "vas a pagar",
]
SEED_WEIGHT = 3.0
#: Set in a token's code, beside its symbol and the end of a clause, where a phrase may start.
ENDING, STARTING = 8, 16

STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'") + "«»“”„’¡¿…"
ENDS = (".", "!", "?", ";", ":", ".\"", "!\"")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer with final outputs on arcs: step(state, symbol) gives the next state and a mark."""

    start: int
    states: int
    arcs: dict[tuple[int, int], tuple[int, int]]


def fading(trigger: int, reach: int) -> Transducer:
    """Marks (1) what follows the trigger within reach symbols of a clause; BREAK ends it. Reach 0: up to the clause's end."""
    arcs, top = {}, max(1, reach)
    for state in range(top + 1):
        for symbol in range(THREAT + 1):
            if symbol == BREAK:
                after = 0
            elif symbol == trigger:
                after = top
            else:
                after = state if not reach else max(0, state - 1)
            arcs[state, symbol] = after, int(state > 0)
    return Transducer(0, top + 1, arcs)


def composed(parts: list[Transducer]) -> Transducer:
    """The product machine: it reads a symbol once and gives the marks of all parts as bits of one number."""
    product = parts[0]
    for bit, part in enumerate(parts[1:], 1):
        arcs = {}
        for (a, symbol), (a_next, a_mark) in product.arcs.items():
            for b in range(part.states):
                b_next, b_mark = part.arcs[b, symbol]
                arcs[a * part.states + b, symbol] = a_next * part.states + b_next, a_mark | b_mark << bit
        product = Transducer(product.start * part.states + part.start, product.states * part.states, arcs)
    return product


def phrases(kinds: dict[int, list[str]]) -> tuple[dict[tuple[int, str], int], dict[int, int]]:
    """A transducer over words: arcs from state 0 along the words of each phrase, and what its last state gives out."""
    arcs: dict[tuple[int, str], int] = {}
    outputs: dict[int, int] = {}
    for symbol, listed in kinds.items():
        for phrase in listed:
            state = 0
            for word in phrase.split():
                state = arcs.setdefault((state, word), len(arcs) + 1)
            outputs[state] = symbol
    return arcs, outputs


#: Insults and threats of several words. What it gives out is read by the machines below, as the words of the lexicon are.
PHRASES, PHRASE_ENDS = phrases({INSULT: INSULT_PHRASES, THREAT: THREAT_PHRASES})
PHRASE_STARTS = {word for state, word in PHRASES if not state}

#: Reads a clause from left to right (targets before, negation, reported speech), and from right to left (targets after).
FORWARD = composed([fading(TARGET, TARGET_REACH), fading(NEGATION, NEGATION_REACH), fading(REPORT, 0)])
BACKWARD = fading(TARGET, TARGET_REACH)
#: Kinds of a match: aimed + 2 * negated + 4 * reported, for insults, then for threats.
KINDS = 16


class Grammar(dict):
    """Code of a raw token: its symbol, plus ENDING if a clause ends after it, plus STARTING if a phrase may start with it.

    Learned terms come before the closed classes.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = {w: SEED_WEIGHT for w in INSULTS} | lexicon
        self.longest = max((len(t) for t in self.lexicon if t.startswith("^")), default=1) - 1
        closed = [(THREATS, THREAT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)]
        self.closed = {w: symbol for words, symbol in closed for w in words}

    def weight(self, token: str) -> float:
        """Greatest weight among the token's words and their stems; 0 if none is in the lexicon."""
        best = 0.0
        for word in LETTERS.findall(token):
            best = max(best, self.lexicon.get(word, 0.0), *(self.lexicon.get("^" + word[:n], 0.0) for n in range(1, min(self.longest, len(word)) + 1)))
        return best

    def __missing__(self, token: str) -> int:
        if len(self) > MEMO_TERMS:
            self.clear()
        bare = token.strip(STRIPPED)
        symbol = INSULT if self.weight(token) > 0 else self.closed.get(bare, OTHER)
        code = self[token] = symbol + ENDING * token.endswith(ENDS) + STARTING * (bare in PHRASE_STARTS)
        return code

    def matches(self, text: str) -> np.ndarray:
        """Weight of the matches of each kind over all clauses of a text."""
        found = np.zeros(KINDS)
        tokens = text.lower().split()
        codes = bytes(map(self.__getitem__, tokens))
        data = np.frombuffer(codes, np.uint8)
        hits = np.flatnonzero(((data & 7) >= INSULT) | (data >= STARTING))
        done = -1
        for hit in hits.tolist():
            if hit <= done:
                continue
            # The clause around the hit: after the end before it, up to its own end.
            begin = hit
            while begin and not codes[begin - 1] & ENDING:
                begin -= 1
            end = hit
            while end + 1 < len(codes) and not codes[end] & ENDING:
                end += 1
            done = end
            clause = codes[begin:end + 1]
            symbols, ended = [c & 7 for c in clause], {}
            if max(clause) >= STARTING:
                ended = self.ended(clause, tokens[begin:end + 1], symbols)
            self.clause(symbols, tokens[begin:end + 1], ended, found)
        return found

    def ended(self, codes: bytes, tokens: list[str], symbols: list[int]) -> dict[int, int]:
        """Run the phrase transducer from each word that may start one: places where a phrase ends and what it gives out.

        That stands there as a symbol, unless the word itself is an insult or a threat. Of phrases from one start the longest counts.
        """
        bare, out = [t.strip(STRIPPED) for t in tokens], {}
        for first in (i for i, c in enumerate(codes) if c >= STARTING):
            state, last = 0, None
            for i in range(first, len(bare)):
                state = PHRASES.get((state, bare[i]))
                if state is None:
                    break
                if state in PHRASE_ENDS:
                    last = i, PHRASE_ENDS[state]
            if last is not None and symbols[last[0]] < INSULT:
                symbols[last[0]] = out[last[0]] = last[1]
        return out

    def clause(self, symbols: list[int], tokens: list[str], ended: dict[int, int], found: np.ndarray) -> None:
        state, marks = FORWARD.start, []
        for symbol in symbols:
            state, mark = FORWARD.arcs[state, symbol]
            marks.append(mark)
        state = BACKWARD.start
        for i in range(len(symbols) - 1, -1, -1):
            state, aimed = BACKWARD.arcs[state, symbols[i]]
            if symbols[i] >= INSULT:
                kind = marks[i] | aimed
                weight = SEED_WEIGHT if i in ended else self.weight(tokens[i])
                found[kind + 8 * (symbols[i] == THREAT)] += weight if symbols[i] == INSULT else 1.0


def terms(text: str) -> set[str]:
    """Whole words of a text and their stems, marked by ^."""
    words = set(LETTERS.findall(text.lower()))
    return words | {"^" + w[:n] for w in words for n in STEM_LETTERS if len(w) >= n}


def new_terms(sample: DataFrame, lexicon: dict[str, float], text: str) -> dict[str, float]:
    """Terms that mark the toxic ones among the documents without a match so far, with their smoothed log odds.

    A term's evidence is twice the log likelihood ratio of its own share of toxic documents against the share of all.
    It has to outweigh the number of terms tried, so that about one term at most gets in by chance at any size. Of nested
    stems in the same documents the longest stays.
    """
    grammar = Grammar(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def passed() -> pa.RecordBatch:
            both = list(held.values())
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64())], names=["term", "toxic", "clean"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if grammar.matches(x or "")[:8].any():
                        continue
                    # The empty term counts the documents themselves.
                    for term in terms(x or "") | {""}:
                        held.setdefault(term, [0, 0])[1 - y] += 1
                    if len(held) > HELD_TERMS:
                        yield passed()
        yield passed()

    counts = stored(sample.select(text, "_y").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    whole = counts.filter("term = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return {}
    toxic, clean = whole["toxic"], whole["clean"]
    base = toxic / (toxic + clean)
    tried = counts.filter("toxic + clean >= 3").count()
    t, c = F.col("toxic"), F.col("clean")
    share = t / (t + c)
    evidence = 2 * (t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0))
    strong = counts.filter((F.col("term") != "") & (t > 0) & (share >= LEAST_SHARE)).filter(evidence >= 2 * math.log(max(2, tried))).collect()
    seen = {r["term"]: (r["toxic"], r["clean"]) for r in strong}
    longer = {term[:-1]: numbers for term, numbers in seen.items() if term.startswith("^")}
    kept = {term: both for term, both in seen.items() if longer.get(term) != both}
    return {term: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for term, (a, b) in kept.items()}


def learned_lexicon(sample: DataFrame, text: str = "text") -> dict[str, float]:
    """Terms found round by round, each round among the documents that the seed and the terms so far leave unexplained."""
    lexicon: dict[str, float] = {}
    for _ in range(ROUNDS):
        found = new_terms(sample, lexicon, text)
        if not found:
            break
        lexicon |= found
    return lexicon


@dataclass
class Model:
    lexicon: dict[str, float]
    bias: float
    weights: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(np.log1p(found) @ self.weights)))))


def prior() -> tuple[float, np.ndarray]:
    """Weights without data: aimed matches count more, negated and reported ones less, threats count when aimed."""
    kinds = np.arange(KINDS)
    aimed, negated, reported, threat = ((kinds >> bit) & 1 for bit in range(4))
    return -3.0, np.where(threat == 1, 0.3 * aimed, 1.5 + 0.7 * aimed) * (1 - 0.6 * negated) * (1 - 0.6 * reported)


def fit(found: np.ndarray, y: np.ndarray, rounds: int = 40, hold: float = 2.0) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton's method that keeps near the prior where data say little."""
    bias, weights = prior()
    centre = np.concatenate([[bias], weights])
    theta = centre.copy()
    x = np.hstack([np.ones((len(y), 1)), np.log1p(found.reshape(-1, KINDS))])
    keep = np.diag([1e-3 if not i else hold for i in range(KINDS + 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + keep @ (theta - centre)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, slope)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return float(theta[0]), theta[1:]


def match_columns(grammar: Grammar, texts: Iterable[str | None]) -> list[np.ndarray]:
    return [grammar.matches(x or "") for x in texts]


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", text: str = "text") -> Model:
    """Lexicon and weights from at most SAMPLE_ROWS labelled documents; without labels the seed lexicon and the prior."""
    sample = stored(labelled_sample(docs.select("doc_id", text), labels, label, train_rows, SAMPLE_ROWS))
    lexicon = learned_lexicon(sample, text)
    grammar = Grammar(lexicon)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = match_columns(grammar, batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array([m.tolist() for m in made], pa.list_(pa.float64()))], names=["doc_id", "y", "found"])

    made = map_batches(sample.select("doc_id", text, "_y"), each, "doc_id long, y int, found array<double>")
    rows = made.dropDuplicates(["doc_id"]).orderBy("doc_id").limit(SAMPLE_ROWS).collect()
    if not rows:
        return Model(lexicon, *prior())
    return Model(lexicon, *fit(np.array([r.found for r in rows]), np.array([r.y for r in rows], float)))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), aimed, negated, reported (weights of matched clauses' insults) for each row.

    Null and empty texts have no clause and get the score of a text without a match. Rows map one to one, repeated and
    null keys included; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    grammars: list[Grammar] = []
    kinds = np.arange(KINDS) % 8

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        grammar = grammars[0] if grammars else grammars.append(Grammar(sent.value.lexicon)) or grammars[0]
        found = match_columns(grammar, batch.column(1).to_pylist())
        parts = [pa.array([float(f[kinds >> bit & 1 == 1].sum()) for f in found], pa.float64()) for bit in range(3)]
        return pa.record_batch([batch.column(0), pa.array([sent.value.score(f) for f in found], pa.float64()), *parts], names=[key, "score", "aimed", "negated", "reported"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), each, f"`{key}` {kind}, score double, aimed double, negated double, reported double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    found = scored(docs, train(docs, labels, ~held_out))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "aimed", "negated", "reported",
    )
