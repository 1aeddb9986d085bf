"""Toxicity by a weighted finite-state pattern grammar.

A text's words and clause ends become symbols: insult (with a weight), threat, target, negation, reporting
verb, modal verb, third person, other, end. Small transducers each mark or rewrite symbols: a target that a modal
verb follows is a subject, negation marks what follows within its reach, reported speech and a third person's doings mark
what follows in the clause, address marks the whole clause of a word that names somebody, and object that of
one who may be acted upon (these guess at the start of a clause, and a wrong guess dies at the end), matching turns
insults and threats into patterns, and the last one tells the first loose insult of a text from further ones.
They are composed once into one machine, which reads a text from end to end. A threat needs an object, and isn't one where
a third person acts: "you can destroy the object" and "they murder him" threaten nobody.

A document's score comes from its patterns, whose weights are fitted by logistic regression on labelled rows and are never
negative. A lone insult that addresses nobody, and insults that are negated or reported, are held below LONE however
often such rows are labelled toxic; insults that address somebody, insults upon insults, and threats against somebody count in full.

Insults and their weights are learned: words and word beginnings that labelled toxic documents use
significantly more often, copies counted once (log-likelihood ratio MIN_RATIO, weight MIN_WEIGHT: the logarithm of how much
more often), counted in one grouped aggregation over at most MAX_FIT labelled rows of each kind. The lists of targets,
negations, reporting verbs and threats are fixed.

Defined results: null and empty texts score as texts without matches; each row gives one row; labels that
are null or of null doc_ids are not used, and of several labels of a doc_id the largest is; a labelled doc_id that
several rows have counts once, with its least text; without labels of both kinds nothing is learned and only threats
count; a very long text is read whole, a clause at a time; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import materialize
from linkwright.shipping import arrow_map

#: Labelled rows of each kind that are learned from.
MAX_FIT = {1: 3000, 0: 9000}
MIN_RATIO, MIN_WEIGHT = 40.0, 4.5
#: Bound on the score of a lone insult.
LONE = 0.65
#: Lengths of the word beginnings that are counted.
PREFIXES = range(4, 9)
#: Weight of a clear insult, from which a match counts in full, and of a threat.
CLEAR = 6.0
#: Words after a negation that it reaches.
REACH = 3
#: Words whose classes a worker keeps; beyond, it starts anew.
MAX_WORDS = 500_000

# Fixed values.
TARGETS = "you your yours u them him her du dich dir ihr euch sie tu te toi vous usted ustedes tú ti"
THIRD = "he she they er il elle ils elles él ella ellos ellas"
MODALS = "can could may might must should would will shall cannot kannst könnt könntest darfst dürft sollst musst peux pouvez devez puedes puede pueden debes"
NEGATIONS = "not no never none nobody without isnt arent dont nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás sin ningún ninguna"
REPORTS = "said says say saying told wrote writes called calls claimed claims quoted quotes sagte sagt schrieb schreibt nannte behauptet dit disait écrit écrivait appelé dijo dice escribió llamó"
THREATS = "kill hurt destroy shoot stab strangle murder töten umbringen verletzen erschießen tuer blesser détruire égorger matar herir destruir apuñalar"

PATTERNS = ("insult", "again", "targeted", "negated", "reported", "threat")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.,;:!?|\n]+")

#: What the machine reads, and the marks that symbols carry from one transducer to the next.
KINDS = ("insult", "threat", "target", "third", "modal", "negation", "report", "other", "end")
Symbol = tuple[str, frozenset]
Arc = tuple[int | str | tuple, Symbol | str | None]


class Transducer:
    """``arcs(state, symbol)`` gives each next state with the symbol that is written; ``final`` says where a text may end."""

    def __init__(self, starts: list, arcs: Callable[[object, object], list[Arc]], final: Callable[[object], bool] = lambda state: True) -> None:
        self.starts, self.arcs, self.final = starts, arcs, final


def marked(s: Symbol, mark: str, on: bool) -> Symbol:
    return (s[0], s[1] | {mark}) if on else s


def following(kind: str, mark: str, reach: int | None) -> Transducer:
    """Marks the next ``reach`` symbols after one of this kind, all of them if None, in its clause."""

    def arcs(left: int, s: Symbol) -> list[Arc]:
        if s[0] == "end":
            return [(0, s)]
        if s[0] == kind:
            return [(reach or 1, s)]
        return [(left if reach is None else max(0, left - 1), marked(s, mark, left > 0))]

    return Transducer([0], arcs)


def subjects() -> Transducer:
    """A target that a modal verb follows at once becomes a subject: the state says what the next symbol has to be."""

    def arcs(state: str, s: Symbol) -> list[Arc]:
        if state != "any" and (s[0] == "modal") != (state == "modal"):
            return []
        return [("modal", ("subject", s[1])), ("other", s)] if s[0] == "target" else [("any", s)]

    return Transducer(["any"], arcs, lambda state: state != "modal")


def around(kinds: tuple[str, ...], mark: str) -> Transducer:
    """Marks all symbols of a clause that has one of these kinds: the states say none, one to come, one seen."""

    def arcs(state: str, s: Symbol) -> list[Arc]:
        if s[0] == "end":
            return [] if state == "to come" else [("none", s), ("to come", s)]
        if s[0] in kinds:
            return [] if state == "none" else [("seen", s)]
        return [(state, marked(s, mark, state != "none"))]

    return Transducer(["none", "to come"], arcs, lambda state: state != "to come")


def matching() -> Transducer:
    """Insults and threats become patterns; a threat needs an object in its clause."""

    def arcs(state: int, s: Symbol) -> list[Arc]:
        kind, marks = s
        if kind == "insult":
            return [(0, next((p for p, m in (("reported", "reported"), ("negated", "negated"), ("targeted", "addressed")) if m in marks), "insult"))]
        return [(0, "threat" if kind == "threat" and "object" in marks and not marks & {"negated", "reported", "narrated"} else None)]

    return Transducer([0], arcs)


def piling() -> Transducer:
    """A loose insult after another insult becomes ``again``."""
    return Transducer([0], lambda seen, p: [(1 if seen or p in ("insult", "targeted") else 0, "again" if seen and p == "insult" else p)])


def composed(parts: list[Transducer]) -> tuple[list[int], dict[tuple[int, str], list[tuple[int, str | None]]], set[int]]:
    """One machine that reads what the first part reads and writes what the last one writes: starts, arcs, final states."""
    number: dict[tuple, int] = {}
    name = lambda states: number.setdefault(states, len(number))
    starts = [name(s) for s in product(*(t.starts for t in parts))]
    arcs, done = {}, 0
    while done < len(number):
        states = list(number)[done]
        for kind in KINDS:
            ways: list[tuple[tuple, object]] = [((), (kind, frozenset()))]
            for t, state in zip(parts, states):
                ways = [(path + (n,), out) for path, s in ways for n, out in t.arcs(state, s)]
            arcs[done, kind] = [(name(path), out) for path, out in ways]
        done += 1
    return starts, arcs, {k for states, k in number.items() if all(t.final(x) for t, x in zip(parts, states))}


STARTS, ARCS, FINAL = composed([
    subjects(),
    following("negation", "negated", REACH),
    following("report", "reported", None),
    following("third", "narrated", None),
    around(("target", "third", "subject"), "addressed"),
    around(("target",), "object"),
    matching(),
    piling(),
])
FIXED = {w: kind for kind, words in (("threat", THREATS), ("report", REPORTS), ("negation", NEGATIONS), ("modal", MODALS), ("third", THIRD), ("target", TARGETS)) for w in words.split()}


def features_of(word: str) -> list[str]:
    """What is counted of a word: itself, and its beginnings, marked by an asterisk."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k <= len(word))]


class Grammar:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.known = lexicon, {}

    def symbol(self, word: str) -> tuple[str, float]:
        """Kind and weight of a word."""
        s = self.known.get(word)
        if s is None:
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            kind = FIXED.get(word)
            weight = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0) if kind is None else 0.0
            s = self.known[word] = ("insult", weight) if weight else (kind or "other", CLEAR)
        return s

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """The patterns matched in each clause that has one."""
        alive: dict[int, list[tuple[str, float]]] = {k: [] for k in STARTS}
        for clause in _CLAUSE.split(text):
            for kind, weight in [*map(self.symbol, _WORD.findall(clause)), ("end", 0.0)]:
                # the paths of one clause differ in what they guess; only one of them comes to its end
                alive = {n: found + [(out, weight)] if out else found for state, found in alive.items() for n, out in ARCS[state, kind]}
            found = next(iter(alive.values()))
            if found:
                yield found
                alive = dict.fromkeys(alive, [])

    def patterns(self, text: str) -> np.ndarray:
        """Weight of each of PATTERNS in the whole text, damped: one clear match counts most."""
        low = text.lower()
        total = np.zeros(len(PATTERNS))
        if not any(self.symbol(w)[0] in ("insult", "threat") for w in set(_WORD.findall(low))):
            return total
        for found in self.clauses(low):
            for name, weight in found:
                total[PATTERNS.index(name)] += min(weight, CLEAR) / CLEAR
        return np.minimum(total, 1) + 0.3 * np.log1p(total)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """(label, text) of at most MAX_FIT rows of each label, one for each id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    of = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(MAX_FIT[k])
    picked = F.broadcast(of(0).unionByName(of(1)))
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, F.col("_doc") == F.col("_id"))
    return materialize(rows.groupBy("_id", "label").agg(F.min("text").alias("text")).select("label", "text"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Insult words and beginnings with their weights: all that are significant."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = {0: Counter(), 1: Counter()}
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                n[label].update({f for w in set(_WORD.findall(text.lower())) if w not in FIXED for f in features_of(w)})
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])

    t_all, c_all = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not t_all or not c_all:
        return {}
    counts = arrow_map(sample, batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / (t_all + c_all)
    ratio = 2 * (a * F.log(a / (t_all * share)) + F.when(b > 0, b * F.log(b / (c_all * share))).otherwise(0.0))
    weight = F.log((a + 0.5) / (t_all + 1)) - F.log((b + 0.5) / (c_all + 1))
    found = counts.where("toxic >= 3 AND toxic > clean").select("feature", ratio.alias("ratio"), weight.alias("weight"))
    return {r["feature"]: r["weight"] for r in found.where((F.col("ratio") >= MIN_RATIO) & (F.col("weight") >= MIN_WEIGHT)).collect()}


def fit_patterns(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of PATTERNS, none negative, and the bias. Both labels weigh the same; a pull towards 4 steadies rare patterns."""
    prior, w, bias = np.full(len(PATTERNS), 4.0), np.full(len(PATTERNS), 4.0), -3.0
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / max(len(y), 1)
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(x @ w + bias))) - y) * share
        w = np.maximum(w - 2.0 * (x.T @ d + 0.002 * (w - prior)), 0.0)
        bias -= 2.0 * d.sum()
    return held_below(np.append(w, min(bias, -1.5)))


def held_below(w: np.ndarray) -> np.ndarray:
    """Weights under which one loose, negated or reported insult scores LONE at most, and all others weigh what a loose one was fitted to."""
    loose = np.isin(PATTERNS, ["insult", "negated", "reported"])
    most = (np.log(LONE / (1 - LONE)) - w[-1]) / (1 + 0.3 * np.log(2))
    return np.append(np.where(loose, np.minimum(w[:-1], most), np.maximum(w[:-1], w[0])), w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, patterns) of every whole text; ``patterns`` maps matched patterns to their damped weights."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col)
    lexicon = learn_lexicon(sample.dropDuplicates(["text"]))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in it:
            x = [grammar.patterns(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = arrow_map(sample, measure, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([r["x"] for r in rows]).reshape(-1, len(PATTERNS))
    w = fit_patterns(x, y) if 0 < y.sum() < len(y) else held_below(np.append(np.full(len(PATTERNS), 4.0), -3.0))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in it:
            x = np.array([grammar.patterns(t) for t in batch["text"].to_pylist()]).reshape(-1, len(PATTERNS))
            found = [[(n, float(v)) for n, v in zip(PATTERNS, r) if v] for r in x]
            score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array(found, pa.map_(pa.string(), pa.float64()))], ["doc_id", "score", "patterns"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, patterns map<string,double>")
