"""Toxicity by a weighted finite-state grammar over clauses.

Words are read by a lexical transducer, a character automaton that writes the classes a
word belongs to: insult (with a weight), threat, target, object, clitic, negation,
report, break.  Insults are words and stems learned from labelled texts; a threat is a
fixed stem followed by one of its language's endings, so that inflected forms are read too.

Clause transducers read those classes, each a table of states: negation and target
count down the words they reach over, a report holds until the clause ends, an object
reaches back to a threat unless an article or preposition stands between ("beat the eggs
for you"), a clitic reaches ahead to one ("te voy a matar").  They are composed into two
tables of states, one read from the left and one from the right, and an insult or threat
leaves the pair with an arc named by the states it stands between: plain, aimed, denied,
reported.  A threat without an object leaves by no arc.  So a clause is a set of weighted
arcs, not a bag of words.  Arc weights are learned with the document score, a logistic
curve over the weighted logarithms of what the arcs carried.

Reading takes time in proportion to the text, however long a clause is.  Only clauses that
hold a possible insult or threat are read word by word; an Aho-Corasick machine finds them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import wordhash as wh
from tideline.llm.common import crc_remainder, documents_columns, output_schema
from tideline.llm.quality import fitted, training_rows

# Word lists in English, German, French and Spanish.  Threats are stems
# with the endings of their language ("-" is no ending).
THREATS = [
    ("kill murder attack hurt shoot shot stab burn beat strangl destroy", "- s e es ed d ing en er t"),
    ("umbring töt getöt schlag schläg geschlag erschieß erschoss verprügel", "- e en t te ten st et n"),
    ("tu frapp détruis détrui tabass poignard", "er e es é ée és ez ons ent erai era re s t sez sent"),
    ("mat golpe destru dispar apuñal", "ar o a as an ó aré ará aron ir yo ye yó iré ando"),
]
TARGETS = "you your youre u he she they them him her du dich dir ihr euch sie tu toi te vous ils elle tú usted ustedes ellos ella".split()
OBJECTS = "you u ya him her them me us everyone dich ihn sie euch mich uns toi vous moi nous eux usted ustedes ellos ellas".split()
CLITICS = "te vous nous dich euch ihn mich uns os".split()
NEGATIONS = ("not no never none isnt arent dont doesnt wasnt isn aren don doesn wasn nicht kein keine nie niemals ne pas jamais "
             "aucun nunca jamás ningún ninguna").split()
REPORTS = "said says say wrote writes called calls quoted claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
BREAKS = ("the a an for with to at in on by from about der die das den dem ein eine für mit zu auf von le la les un une pour avec à "
          "dans sur el los las una para con por en").split()

CONTEXTS = ("plain", "aimed", "denied", "reported", "denied-reported")
ARCS = [f"{kind}-{context}" for kind in ("insult", "threat") for context in CONTEXTS]

# Classes of words: a word's set of them is one symbol of the clause transducers.
INSULT, THREAT, TARGET, OBJECT, CLITIC, NEGATION, REPORT, BREAK = (1 << k for k in range(8))
SYMBOLS = 256

# How far, in words, a target, object, clitic or negation reaches within a clause.
REACH = 4

# Learning the lexicon: a word or stem is an insult if its log-odds of the toxic class
# are at least this, and it is in more toxic texts than the most telling of all words
# would be by chance (log-likelihood ratio above the logarithm of their number).
STEM_LETTERS = (4, 5, 6)
LEAST_LOG_ODDS = 2.0
# Bound of the training sample: rows, taken by hash, and bytes of their texts.
TRAIN_ROWS = 10_000
TRAIN_BYTES = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n|]+")


@dataclass
class Grammar:
    """Insult entries (a trailing * marks a stem) with log-odds, arc weights and the bias."""

    insults: dict[str, float] = field(default_factory=dict)
    arcs: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


class Lexicon:
    """The lexical transducer: character arcs, and what a word writes where it ends.

    A learned stem writes its weight for every longer word, so its last state keeps
    itself whatever follows.
    """

    def __init__(self, insults: dict[str, float]):
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: list[tuple[int, float]] = [(0, 0.0)]
        self.beyond: list[float] = [0.0]
        for stems, endings in THREATS:
            for stem in stems.split():
                for ending in endings.split():
                    self._add(stem + ending.replace("-", ""), THREAT)
        for words, kind in ((TARGETS, TARGET), (OBJECTS, OBJECT), (CLITICS, CLITIC), (NEGATIONS, NEGATION),
                            (REPORTS, REPORT), (BREAKS, BREAK)):
            for word in words:
                self._add(word, kind)
        for entry, weight in insults.items():
            if entry.endswith("*"):
                self.beyond[self._state(entry[:-1])] = weight
            else:
                self._add(entry, INSULT, weight)

    def _state(self, word: str) -> int:
        at = 0
        for letter in word:
            if letter not in self.arcs[at]:
                self.arcs[at][letter] = len(self.arcs)
                self.arcs.append({})
                self.writes.append((0, 0.0))
                self.beyond.append(0.0)
            at = self.arcs[at][letter]
        return at

    def _add(self, word: str, kind: int, weight: float = 0.0) -> None:
        at = self._state(word)
        self.writes[at] = (self.writes[at][0] | kind, max(self.writes[at][1], weight))

    def read(self, word: str) -> tuple[int, float]:
        """(classes, weight) that a word writes."""
        at, best, last = 0, 0.0, len(word) - 1
        for i, letter in enumerate(word):
            at = self.arcs[at].get(letter, -1)
            if at < 0:
                break
            if i < last:
                best = max(best, self.beyond[at])
        kinds, weight = self.writes[at] if at >= 0 else (0, 0.0)
        weight = max(weight, best)
        # An insult is read as nothing else.
        return (INSULT, weight) if weight > 0 else (kinds, 0.0)

    def hits(self) -> Iterator[str]:
        """Beginnings of every word that is an insult or a threat."""
        stack = [(0, "")]
        while stack:
            at, word = stack.pop()
            if self.beyond[at] or self.writes[at][0] & (INSULT | THREAT):
                yield word
            stack.extend((to, word + letter) for letter, to in self.arcs[at].items())


@dataclass(frozen=True)
class Transducer:
    """States from 0; ``step`` gives the next for a symbol, and states above 0 write the mark."""

    states: int
    step: Callable[[int, int], int]


def within_reach(opens: int, closes: int = 0, reach: int = REACH) -> Transducer:
    """Marks the next ``reach`` words after a word of class ``opens``, up to one of class ``closes``."""
    return Transducer(reach + 1, lambda state, symbol: (
        reach if symbol & opens else 0 if symbol & closes else max(state - 1, 0)))


def from_now_on(opens: int) -> Transducer:
    """Marks every word after one of class ``opens``."""
    return Transducer(2, lambda state, symbol: 1 if symbol & opens else state)


def composed(*parts: Transducer) -> tuple[list[list[int]], list[int]]:
    """(next state by state and symbol, marks by state) of transducers that read side by side.

    States are the reachable tuples of the parts' states; bit k of the marks is part k's.
    """
    numbers = {(0,) * len(parts): 0}
    order = [(0,) * len(parts)]
    table = []
    for state in order:
        row = []
        for symbol in range(SYMBOLS):
            to = tuple(part.step(own, symbol) for part, own in zip(parts, state, strict=True))
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        table.append(row)
    return table, [sum((own > 0) << k for k, own in enumerate(state)) for state in order]


# Read from the left: denied 1, reported 2, target before 4, clitic before 8; from the
# right: target after 1, object after 2.
@lru_cache(maxsize=1)
def machines() -> tuple[tuple[list[list[int]], list[int]], tuple[list[list[int]], list[int]]]:
    """The composed clause transducers, from the left and from the right."""
    left = composed(within_reach(NEGATION), from_now_on(REPORT), within_reach(TARGET), within_reach(CLITIC))
    right = composed(within_reach(TARGET), within_reach(OBJECT, closes=BREAK))
    return left, right


class Reader:
    """A grammar's lexical transducer, followed by the clause transducers."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.lexicon = Lexicon(grammar.insults)
        self.word = lru_cache(maxsize=1 << 16)(self.lexicon.read)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for beginning in self.lexicon.hits():
            self.machine.add_word(beginning)
        self.machine.make_automaton()

    def clause(self, text: str) -> list[tuple[str, float, int, int]]:
        """(arc, weight, start, end) of the insults and threats of a lower-cased clause."""
        (left, left_marks), (right, right_marks) = machines()
        symbols = bytearray()
        hits: list[tuple[int, int, float, int, int, int]] = []
        state = 0
        for found in _WORD.finditer(text):
            symbol, weight = self.word(found.group())
            if symbol & (INSULT | THREAT):
                hits.append((len(symbols), symbol, weight, left_marks[state], found.start(), found.end()))
            state = left[state][symbol]
            symbols.append(symbol)
        out = []
        state, at = 0, len(symbols)
        for place, symbol, weight, before, start, end in reversed(hits):
            while at > place + 1:
                at -= 1
                state = right[state][symbols[at]]
            after = right_marks[state]
            if symbol & INSULT:
                kind, aimed = "insult", before & 4 or after & 1
            else:
                kind, weight, aimed = "threat", 1.0, before & 8 or after & 2
                if not aimed:
                    continue
            denied, reported = before & 1, before & 2
            context = ("denied-reported" if denied and reported else "denied" if denied
                       else "reported" if reported else "aimed" if aimed else "plain")
            out.append((f"{kind}-{context}", weight, start, end))
        return out[::-1]

    def clauses(self, text: str) -> Iterator[tuple[int, str, list[tuple[str, float, int, int]]]]:
        """(start, clause, arcs) of the clauses that leave the automaton."""
        low = text.lower()
        done = -1
        ends = None
        for end, length in self.machine.iter(low):
            start = end - length + 1
            if start < done or (start and low[start - 1].isalnum()):
                continue
            if ends is None:
                ends = np.array([0, *(m.end() for m in _CLAUSE_END.finditer(low)), len(low)])
            k = int(np.searchsorted(ends, start, side="right")) - 1
            first, done = int(ends[k]), int(ends[min(k + 1, len(ends) - 1)])
            clause = low[first:done]
            arcs = self.clause(clause)
            if arcs:
                yield first, clause, arcs

    def counts(self, text: str) -> Counter:
        """Sum of the weights that each arc carried in a text."""
        out: Counter = Counter()
        for _, _, arcs in self.clauses(text):
            for arc, weight, _, _ in arcs:
                out[arc] += weight
        return out

    def weigh(self, counts: Counter) -> float:
        """Score of a text from the weights that its arcs carried."""
        total = self.grammar.bias
        for arc, amount in counts.items():
            total += self.grammar.arcs.get(arc, 0.0) * np.log1p(amount)
        return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def _entries(text: str) -> set[str]:
    """Words of a text, and the stems of its longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEM_LETTERS if len(w) > n}


def _apart(texts: list[str]) -> list[bool]:
    """Which texts are no near copies of earlier ones, by two min-hashes of word triples."""
    seen: tuple[set[int], set[int]] = (set(), set())
    out = []
    for piece in wh.texts_of(pa.array(texts, pa.string())):
        for values in wh.shingle_sets(piece, wh.non_space(), 3):
            ends = (int(values[0]), int(values[-1])) if len(values) else (0, 0)
            out.append(all(e not in s for e, s in zip(ends, seen, strict=True)))
            for e, s in zip(ends, seen, strict=True):
                s.add(e)
    return out


def learn_insults(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Words and stems that tell toxic texts from others, with their log-odds.

    Near copies count once: in a family of them every word would tell.
    """
    apart = np.array(_apart(texts), dtype=bool)
    n = np.array([max(1, int((labels[apart] == 0).sum())), max(1, int((labels[apart] == 1).sum()))])
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    share = n[1] / n.sum()
    for text, label, use in zip(texts, labels, apart, strict=True):
        if use and label == 1:
            counts[1].update(_entries(text))
    chance = np.log(len(counts[1]) / share + 1) + 1
    # No entry of fewer toxic texts can beat chance; the driver holds only the others.
    counts = (Counter(), Counter({e: k for e, k in counts[1].items() if -k * np.log(share) >= chance}))
    for text, label, use in zip(texts, labels, apart, strict=True):
        if use and label == 0:
            counts[0].update(counts[1].keys() & _entries(text))
    found = {}
    for entry, toxic in counts[1].items():
        clean = counts[0][entry]
        of_all = toxic + clean
        ratio = toxic * np.log(toxic / (of_all * share)) + (clean * np.log(clean / (of_all * (1 - share))) if clean else 0.0)
        odds = np.log((toxic + 0.1) / n[1]) - np.log((clean + 0.1 + 0.01 * toxic) / n[0])
        if ratio >= chance and odds >= LEAST_LOG_ODDS:
            found[entry] = (float(odds), toxic)
    # The most telling first, and no entry whose texts a stem of it already covers.
    best = sorted(found, key=lambda e: (-found[e][0] * np.sqrt(found[e][1]), e))
    kept: dict[str, float] = {}
    for entry in best:
        stems = {f"{entry[:n]}*" for n in STEM_LETTERS if len(entry.rstrip("*")) > n} - {entry}
        if not stems & kept.keys():
            kept[entry] = found[entry][0]
    return kept


def train(texts: list[str], labels: np.ndarray) -> Grammar:
    """A grammar learned from labelled texts; constant where a class is missing.

    The lexicon comes from one half of the texts and the arc weights from the
    other, so that an entry is weighed by texts that did not choose it.
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Grammar(bias=4.0 if share else -4.0)
    half = np.arange(len(texts)) % 2 == 0
    first = learn_insults([t for t, h in zip(texts, half, strict=True) if h], labels[half])
    draft = Reader(Grammar(first))
    rows = np.zeros((len(texts), len(ARCS)))
    for i, text in enumerate(texts):
        if not half[i]:
            for arc, amount in draft.counts(text).items():
                rows[i, ARCS.index(arc)] = np.log1p(amount)
    x, y = rows[~half], labels[~half]
    # Logistic regression with a pull towards a prior: every arc is somewhat toxic.
    prior = np.array([{"plain": 1.0, "aimed": 1.5, "denied": 0.7, "reported": 0.7, "denied-reported": 0.4}[a.split("-", 1)[1]] for a in ARCS])
    weights, bias = prior.copy(), float(np.log(share / (1 - share)))
    step_w, step_b = np.full(len(ARCS), 1e-8), 1e-8
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        grad = x.T @ (p - y) / len(y) + 0.002 * (weights - prior)
        slope = float((p - y).mean())
        step_w += grad ** 2
        step_b += slope ** 2
        weights -= 0.3 * grad / np.sqrt(step_w)
        bias -= 0.3 * slope / np.sqrt(step_b)
    # The lexicon itself is learned again from every text.
    return Grammar(learn_insults(texts, labels), dict(zip(ARCS, np.maximum(weights, 0.05).tolist(), strict=True)), bias)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Grammar:
    """A grammar from the rows of ``labels`` that ``allowed`` admits."""
    return fitted(training_rows(docs, labels, "toxic", allowed, TRAIN_ROWS, TRAIN_BYTES), train)


_READERS: dict[int, Reader] = {}


def _reader(grammar) -> Reader:
    """One automaton per worker and grammar."""
    key = id(grammar.value)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(grammar.value)
    return _READERS[key]


def _accept(grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(grammar)
        for batch in batches:
            clean = [reader.weigh(reader.counts(v.as_py() or "")) < 0.5 for v in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _score(grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(grammar)
        for batch in batches:
            scores, matched = [], []
            for value in batch.column("text"):
                counts = reader.counts(value.as_py() or "")
                scores.append(reader.weigh(counts))
                matched.append(sorted(counts))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores, pa.float64()), pa.array(matched, pa.list_(pa.string()))],
                names=[*names, "score", "arcs"])

    return run


def scored(docs: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """The keys, score (0 to 1, higher: toxic likelier) and arcs taken of each whole text.

    A null text scores like an empty one, by the bias; repeated rows score alike;
    other columns than keys and text are not read.
    """
    rows = documents_columns(docs, [*keys, "text"])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(grammar)),
                           output_schema(rows, keys, "score double, arcs array<string>"))


def matched_clauses(text: str, grammar: Grammar) -> list[dict]:
    """The clauses of one text that the grammar matches, with their arcs."""
    return [{"start": first, "clause": clause, "arcs": [(a, w) for a, w, _, _ in arcs]}
            for first, clause, arcs in Reader(grammar).clauses(text)]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity per document: doc_id, held_out, score, predicted.

    Labels of ids whose crc32 as text is divisible by 5 are never learned from.
    """
    held_out = crc_remainder("doc_id", 5) == 0
    grammar = fit(docs, labels, ~held_out)
    return scored(docs, grammar, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that ``score_documents`` does not call toxic."""
    grammar = fit(docs, labels, crc_remainder("doc_id", 5) != 0)
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(grammar)), docs.schema)
