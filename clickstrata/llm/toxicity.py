"""Toxicity by a weighted finite-state pattern grammar.

Method: a lexical transducer turns the words of a clause into classes (insult, threat, target, negation, reporting verb),
each with a weight. Transducers for negation, reported speech, threats and targets are composed with each other into one
deterministic machine, which rewrites the class sequence: an insult under negation, in reported speech, aimed at someone,
or plain, and threats aimed at someone. Its arcs carry weights: where machines are composed weights multiply, along a
clause they add up. A clause is what stands between two of ``CLAUSE_END``, however long; one that holds a single word
matches nothing, so isolated words score nothing. A text's score is a logistic function of what its clauses add up to.

Insults and arc weights are learnt from labelled rows: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of them and at most
``SAMPLE_BYTES`` of their texts, whole texts in the order of the hash of their id, the only bounds that rows are chosen
by. Insults are words or stems that explain toxic texts which the ones before them do not; so words that only copies of a
toxic text share are not taken for insults. The other classes are the fixed word lists below.

Null texts count as empty; they and texts without matches get the base score. Without toxic labels every score is 0.
Null labels and ids are not learnt from; of rows that share an id the greatest text is learnt from, and an id with both
labels counts as toxic. Empty tables give no rows. Repeated rows are scored each; other columns are never inputs. A very
long text is read once, its clauses one after the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import small_batches

TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1500, 2500, 64 << 20
#: Lengths of stems; texts, and share of toxic texts, that an insult must explain; its least ratio of toxic to clean share.
STEMS, LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = range(4, 9), 3, 0.005, 4.0
#: Words of the other classes, in English, German, French and Spanish.
THREATS = "kill murder hurt beat destroy shoot stab burn hang strangle töten umbringen schlagen verprügeln erschießen tuer frapper détruire égorger matar golpear destruir degollar"
TARGETS = "you your yours yourself u du dich dir dein deine deinen ihr euch tu te toi vous votre ton ta tú ti vosotros usted ustedes tus"
NEGATIONS = "not no never neither nor nobody isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna"
REPORTS = "said says say called calls wrote writes told claimed claims quoted according sagte sagt nannte nennt schrieb behauptet dit disait appelé écrit affirme dijo dice llamó escribió afirma"
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic, letter to letter: arcs (state, symbol) to (state, symbol, weight); a symbol without an arc is copied with
    weight 1 to the rest state."""

    arcs: dict[tuple, tuple]
    rest: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        found = self.arcs.get((state, symbol))
        return found if found is not None else (self.rest.get(state, state), symbol, 1.0)

    def run(self, symbols: list[str]) -> list[str]:
        """What it writes."""
        return [symbol for symbol, _ in self.weighed(symbols)]

    def weighed(self, symbols: list[str]) -> Iterator[tuple[str, float]]:
        """What it writes, and the weight of each arc."""
        state = self.start
        for s in symbols:
            state, made, weight = self.step(state, s)
            yield made, weight


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that runs ``second`` on what ``first`` writes; weights multiply."""
    start = (first.start, second.start)
    arcs, open_, seen = {}, [start], {start}
    while open_:
        a, b = state = open_.pop()
        for s in alphabet:
            a2, mid, one = first.step(a, s)
            b2, out, two = second.step(b, mid)
            arcs[state, s] = ((a2, b2), out, one * two)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                open_.append((a2, b2))
    return Transducer(arcs, {}, start)


#: What the grammar writes for a match: negated, reported, aimed and plain insult, aimed threat.
PATHS = "IJiqK"
ALPHABET = "ITYNRo"


def grammar(weights: dict[str, float] | None = None) -> Transducer:
    """Classes: I insult, T threat, Y target, N negation, R report, o other. Writes i (negated), q (reported), J (aimed
    insult), I (plain insult), K (aimed threat), o. ``weights`` by PATHS go to the arcs that write them (without: 1), and other
    arcs weigh nothing."""
    scope = 4
    negation = Transducer({(0, "N"): (scope, "o", 1.0)} | {(k, "N"): (0, "o", 1.0) for k in range(1, scope + 1)} | {(k, a): (k - 1, b, 1.0) for k in range(1, scope + 1) for a, b in (("I", "i"), ("T", "t"))}, {k: k - 1 for k in range(1, scope + 1)})
    report = Transducer({(0, "R"): (1, "o", 1.0), (1, "R"): (1, "o", 1.0)} | {(1, s): (1, "q", 1.0) for s in "IiTt"})
    reach = 6
    aim = {(k, "Y"): (reach, "o", 1.0) for k in range(reach + 1)} | {(k, "I"): (k - 1, "J", 1.0) for k in range(1, reach + 1)}
    insult = Transducer(aim, {k: k - 1 for k in range(1, reach + 1)})
    # a threat waits for its target, which insult aiming must still see: the threat is weighed first
    threat = Transducer({(k, "T"): (reach, "o", 1.0) for k in range(reach + 1)} | {(k, "Y"): (0, "K", 1.0) for k in range(1, reach + 1)}, {k: k - 1 for k in range(1, reach + 1)})
    # one state: reads each match with its weight, and whatever else with none
    scale = Transducer({(0, s): (0, s, (weights or dict.fromkeys(PATHS, 1.0)).get(s, 0.0)) for s in "ITYNRoitqJK"})
    machine = negation
    for more in (report, threat, insult, scale):
        machine = compose(machine, more, ALPHABET)
    return machine


@dataclass(frozen=True)
class Model:
    """insults: word, or stem with a star, to weight; the arc weights by path; the weight of the text's length; bias."""

    insults: dict[str, float]
    arcs: dict[str, float]
    length: float
    bias: float

    def logit(self, matched: float, chars: int) -> float:
        return matched + self.length * _length(chars) + self.bias


def _length(chars: int) -> float:
    return math.log1p(chars) / 10


class Matcher:
    """Finds clauses that hold an insult or a threat and runs the grammar on them."""

    def __init__(self, insults: dict[str, float], arcs: dict[str, float] | None = None):
        self.insults = insults
        self.classes = {w: c for c, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words.split()}
        self.threats = set(THREATS.split())
        self.stems = defaultdict(dict)
        for w in insults:
            if w.endswith("*"):
                self.stems[len(w) - 1][w[:-1]] = w
        self.machine = grammar(arcs)
        self.search = ahocorasick.Automaton()
        for w in [*insults, *self.threats]:
            self.search.add_word(w.rstrip("*"), len(w.rstrip("*")))
        self.search.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of a word as an insult, 0 if it is none."""
        found = self.insults.get(word, 0.0)
        for n, stems in self.stems.items():
            if len(word) > n and (stem := stems.get(word[:n])):
                found = max(found, self.insults[stem])
        return found

    def read(self, word: str) -> tuple[str, float]:
        """The lexical transducer: a word's class and weight."""
        if weight := self.insult(word):
            return "I", weight
        return ("T", 1.0) if word in self.threats else (self.classes.get(word, "o"), 1.0)

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words of each clause in which an insult or a threat may stand."""
        lower = text.lower()
        done = 0
        for end, size in self.search.iter(lower):
            at = end - size + 1
            if at < done or at and (lower[at - 1].isalnum()):
                continue
            begin = max((m.end() for m in CLAUSE_END.finditer(lower, done, at)), default=done)
            stop = m.start() if (m := CLAUSE_END.search(lower, end)) else len(lower)
            done = stop
            yield WORD.findall(lower[begin:stop])

    def paths(self, text: str) -> dict[str, float]:
        """By path, what the clauses' matches add up to."""
        sums = dict.fromkeys(PATHS, 0.0)
        for words in self.clauses(text):
            if len(words) > 1:
                read = [self.read(w) for w in words]
                for (_, lexical), (path, arc) in zip(read, self.machine.weighed([c for c, _ in read]), strict=True):
                    if path in sums:
                        sums[path] += lexical * arc
        return sums

    def matched(self, text: str) -> float:
        """What all clauses add up to."""
        return sum(self.paths(text).values())


def learn_insults(texts: list[str], toxic: list[bool]) -> dict[str, float]:
    """Words and stems, each of which explains toxic texts that those before it do not, with log-odds as weights."""
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    if not n_toxic:
        return {}

    def traits(text: str) -> set[str]:
        words = set(WORD.findall(text.lower()))
        return {w for w in words if len(w) > 2} | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}

    has: dict[str, list[int]] = defaultdict(list)
    for i, (text, is_toxic) in enumerate(zip(texts, toxic, strict=True)):
        if is_toxic:
            for t in traits(text):
                has[t].append(i)
    has = {t: held for t, held in has.items() if len(held) >= LEAST_TEXTS}
    clean = Counter()
    for text, is_toxic in zip(texts, toxic, strict=True):
        if not is_toxic:
            clean.update(traits(text) & has.keys())
    ratio = {t: (len(held) / n_toxic) / ((clean[t] + 0.5) / (n_clean + 1)) for t, held in has.items()}
    has = {t: held for t, held in has.items() if ratio[t] >= LEAST_RATIO}
    gain = {t: float(len(held)) for t, held in has.items()}
    by_text: dict[int, list[str]] = defaultdict(list)
    for t, held in has.items():
        for i in held:
            by_text[i].append(t)
    # a clean text with the trait counts against it as so many toxic ones as its share is larger
    cost = {t: 3.0 * clean[t] * n_toxic / max(n_clean, 1) for t in has}
    need = dict.fromkeys(by_text, 2)
    out: dict[str, float] = {}
    while gain:
        best = max(gain, key=lambda t: (gain[t] - cost[t], len(t.rstrip("*")), t))
        if gain[best] - cost[best] < max(LEAST_TEXTS, LEAST_SHARE * n_toxic):
            break
        out[best] = math.log(ratio[best])
        for i in has[best]:
            need[i] -= 1
            if need[i] == 0:
                for t in by_text[i]:
                    if t in gain:
                        gain[t] -= 1
        # what begins with it, or what it begins with, is seen in the same words
        base = best.rstrip("*")
        gain = {t: n for t, n in gain.items() if not (t.startswith(base) or base.startswith(t.rstrip("*")))}
    return out


def learn_weights(x: np.ndarray, y: np.ndarray, positive: int, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, classes weighted alike; the first ``positive`` weights are not negative."""
    held = np.column_stack([x, np.ones(len(x))])
    share = np.where(y, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    theta = np.zeros(held.shape[1])
    free = np.ones(len(theta), bool)
    penalty = np.full(len(theta), ridge)
    penalty[-1] = 1e-6
    for _ in range(4):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(held @ theta, -30, 30)))
            slope = held.T @ (share * (y - p)) - penalty * theta
            curve = (held * (share * p * (1 - p))[:, None]).T @ held + np.diag(penalty)
            step = np.zeros(len(theta))
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            theta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        below = (theta < 0) & (np.arange(len(theta)) < positive) & free
        if not below.any():
            break
        theta[below] = 0
        free &= ~below
    return theta[:-1], float(theta[-1])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[bool]]:
    """Texts and labels to learn from, in the order of their ids: at most TOXIC_ROWS, CLEAN_ROWS and SAMPLE_BYTES."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most TOXIC_ROWS + CLEAN_ROWS pairs of numbers
    marked = F.broadcast(few(1, TOXIC_ROWS).unionByName(few(0, CLEAN_ROWS)))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id")
    sizes = held.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"), F.xxhash64("doc_id").alias("rank")).collect()
    total, ids = 0, []
    for r in sorted(sizes, key=lambda r: (r["rank"], r.doc_id)):
        total += r.size
        if total > SAMPLE_BYTES:
            break
        ids.append(r.doc_id)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    rows = held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.toxic == 1 for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out."""
    texts, toxic = sample(docs, labels)
    if not any(toxic):
        return Model({}, {}, 0.0, 0.0)
    insults = learn_insults(texts, toxic)
    matcher = Matcher(insults)
    found, lengths, y = [matcher.paths(t) for t in texts], np.array([_length(len(t)) for t in texts]), np.array(toxic)
    # first what one path says against another, then, with that on the arcs, what all matches of a text say together
    by_path, _ = learn_weights(np.column_stack([*[[math.log1p(p[s]) for p in found] for s in PATHS], lengths]), y, len(PATHS))
    arcs = dict(zip(PATHS, by_path[:-1].tolist(), strict=True))
    (matches, length), bias = learn_weights(np.column_stack([[sum(arcs[s] * p[s] for s in PATHS) for p in found], lengths]), y, 1)
    return Model(insults, {s: x * float(matches) for s, x in arcs.items()}, float(length), bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.insults, model.arcs) if model.arcs else None
        for batch in batches:
            if matcher is None:
                scores = np.zeros(batch.num_rows)
            else:
                held = [t.as_py() or "" for t in batch.column(1)]
                scores = 1 / (1 + np.exp(-np.clip([model.logit(matcher.matched(t), len(t)) for t in held], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.insults, model.arcs)
        for batch in batches:
            held = [t.as_py() or "" for t in batch.column(text_col)]
            yield batch.filter(pa.array([model.logit(matcher.matched(t), len(t)) < 0 for t in held], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema) if model.arcs else docs
