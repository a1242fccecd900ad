"""Toxicity by a weighted finite-state pattern grammar.

A scanner turns a clause into symbols: I insult, H threat, T target, N negation, D negating determiner, R verb of saying,
Q quotation mark, C comma or colon, and `.` for other words. Four transducers are composed into one machine:

* negation weakens insults and threats in its scope, which a comma ends;
* aim tells insults with a target near them from bare ones, which weigh little;
* threat keeps threats that a target follows and drops the others;
* report weakens what stands in reported speech: from a verb of saying to a comma, or in the quotation behind it.

Arcs carry factors, which composition multiplies; a path weighs the sum over its arcs of factor times the strength of the
word, and a clause scores its best path. What follows a word is guessed and checked later (`Ahead`), so a symbol string
has one path that ends well.

Insults are learned: words and word beginnings that labelled toxic documents use and others do not, with their log-odds
as strengths. The closed classes (pronouns, negations, verbs of saying and threatening) are given. A logistic curve from
the sum of clause scores to the label is fitted on another fold than the lexicon.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import HELD_OUT, fold, whole

# Fixed word classes in English, German, French and Spanish.
TARGETS = frozenset("you your yourself he him she her they them people du dich dir ihr euch sie er leute tu toi vous il elle ils gens usted ustedes ellos ella gente".split())
NEGATIONS = frozenset("not never isn't aren't wasn't weren't don't doesn't didn't nicht nie niemals ne pas jamais nunca jamás".split())
DETERMINERS = frozenset("no kein keine keinen keiner aucun aucune ningún ninguna".split())
REPORTS = frozenset(
    "said says say wrote writes claimed claims quoted quotes reported told tells called sagte sagt schrieb behauptete meinte erzählte dit écrit affirmé raconté dijo dice escribió afirmó contó".split()
)
THREATS = frozenset("kill murder destroy hurt beat stab shoot strangle töten umbringen erschießen schlagen tuer frapper étrangler matar golpear".split())
THREAT_WEIGHT = 4.0

TOKEN = re.compile(r"([^\W\d_]+(?:'[^\W\d_]+)?)|([,:])|([\"“”„«»])")
CLAUSE = re.compile(r"[.!?;\n]+")
LENGTHS = (4, 5, 6)

#: Symbols of words and marks; lower case marks a negated one, X and Y are an insult and a threat at a target.
WORDS, MARKS = "IHTNDR.", "QC"
NEGATED, AIMED, BARE, REPORTED = 0.25, 1.25, 0.5, 0.6
#: Words that a negation and a negating determiner reach; words between an insult or a threat and its target.
NOT_REACH, NO_REACH, BEFORE, BEHIND, THREATENED = 4, 2, 6, 4, 3

Rule = Callable[[Hashable, str], Iterable[tuple[str, float, Hashable]]]


@dataclass
class Transducer:
    """Arcs (state, symbol) -> [(symbol written, factor, next state)]; a path must end in one of `finals`."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], list[tuple[str, float, Hashable]]]
    finals: set[Hashable]

    @classmethod
    def of(cls, start: Hashable, symbols: str, rule: Rule, final: Callable[[Hashable], bool] = lambda state: True) -> Transducer:
        """The states that can be reached, by a rule that gives the arcs of a state for a symbol."""
        arcs, states, todo = {}, {start}, [start]
        while todo:
            state = todo.pop()
            for symbol in symbols:
                arcs[state, symbol] = list(rule(state, symbol))
                new = {n for _, _, n in arcs[state, symbol]} - states
                states |= new
                todo.extend(new)
        return cls(start, arcs, {s for s in states if final(s)})

    def compose(self, other: Transducer) -> Transducer:
        """What this one writes, the other one reads; factors multiply."""

        def rule(state: Hashable, symbol: str) -> Iterator[tuple[str, float, Hashable]]:
            for middle, factor, mine in self.arcs.get((state[0], symbol), ()):
                for written, more, theirs in other.arcs.get((state[1], middle), ()):
                    yield written, factor * more, (mine, theirs)

        symbols = "".join(sorted({symbol for _, symbol in self.arcs}))
        return Transducer.of((self.start, other.start), symbols, rule, lambda s: s[0] in self.finals and s[1] in other.finals)

    def best(self, symbols: str, strengths: list[float]) -> float:
        """The weight of the best path: the sum of factor times strength over its arcs."""
        reached = {self.start: 0.0}
        for symbol, strength in zip(symbols, strengths):
            following: dict[Hashable, float] = {}
            for state, total in reached.items():
                for _, factor, new in self.arcs.get((state, symbol), ()):
                    weight = total + factor * strength
                    if weight > following.get(new, -math.inf):
                        following[new] = weight
            reached = following
        return max((total for state, total in reached.items() if state in self.finals), default=0.0)


@dataclass(frozen=True)
class Ahead:
    """Guesses about the words to come: no target in the next `without` words, one in the next `within`."""

    without: int = 0
    within: int = 0

    def passing(self, symbol: str) -> Ahead | None:
        """The guesses behind a symbol, or None if it proves one wrong. Marks are not counted."""
        if symbol in MARKS:
            return self
        if symbol == "T":
            return None if self.without else Ahead()
        if self.within == 1:
            return None
        return Ahead(max(0, self.without - 1), max(0, self.within - 1))

    def guess(self, reach: int, target: bool) -> Ahead | None:
        """One more guess, or None if it contradicts those that are held."""
        if target:
            return None if self.without >= reach else Ahead(self.without, self.within or reach)
        return None if self.within else Ahead(reach, 0)


def negation() -> Transducer:
    def rule(left: int, symbol: str) -> Iterator[tuple[str, float, int]]:
        if symbol in MARKS:
            yield symbol, 1.0, 0 if symbol == "C" else left
        elif symbol in "ND":
            yield symbol, 1.0, max(left - 1, NOT_REACH if symbol == "N" else NO_REACH)
        elif symbol in "IH" and left:
            yield symbol.lower(), NEGATED, left - 1
        else:
            yield symbol, 1.0, max(0, left - 1)

    return Transducer.of(0, WORDS + MARKS, rule)


def aim() -> Transducer:
    """State: words for which the last target still counts, and the guesses."""

    def rule(state: tuple[int, Ahead], symbol: str) -> Iterator[tuple[str, float, tuple[int, Ahead]]]:
        left, ahead = state
        after = ahead.passing(symbol)
        if after is None:
            return
        if symbol in MARKS:
            yield symbol, 1.0, (left, after)
            return
        now = BEFORE if symbol == "T" else max(0, left - 1)
        if symbol not in "Ii":
            yield symbol, 1.0, (now, after)
        elif left:
            yield "X", AIMED, (now, after)
        else:
            for target, factor, written in ((True, AIMED, "X"), (False, BARE, "I")):
                held = after.guess(BEHIND, target)
                if held is not None:
                    yield written, factor, (now, held)

    return Transducer.of((0, Ahead()), WORDS + MARKS + "ih", rule, lambda s: not s[1].within)


def threat() -> Transducer:
    def rule(ahead: Ahead, symbol: str) -> Iterator[tuple[str, float, Ahead]]:
        after = ahead.passing(symbol)
        if after is None:
            return
        if symbol not in "Hh":
            yield symbol, 1.0, after
            return
        for target, factor, written in ((True, 1.0, "Y"), (False, 0.0, ".")):
            held = after.guess(THREATENED, target)
            if held is not None:
                yield written, factor, held

    return Transducer.of(Ahead(), WORDS + MARKS + "hX", rule, lambda s: not s.within)


def report() -> Transducer:
    """States: own words, behind a verb of saying, behind its comma, in its quotation."""

    def rule(state: str, symbol: str) -> Iterator[tuple[str, float, str]]:
        if symbol == "R" and state != "quoted":
            new = "said"
        elif symbol == "Q":
            new = "own" if state in ("own", "quoted") else "quoted"
        elif symbol == "C":
            new = "comma" if state == "said" else state
        else:
            new = "own" if state == "comma" else state
        yield symbol, REPORTED if new in ("said", "quoted") and symbol in "IXY" else 1.0, new

    return Transducer.of("own", WORDS + MARKS + "XY", rule)


def cascade() -> list[Transducer]:
    return [negation(), aim(), threat(), report()]


@cache
def machine() -> Transducer:
    """The composition of the cascade."""
    first, *rest = cascade()
    for one in rest:
        first = first.compose(one)
    return first


@dataclass
class Grammar:
    """Learned insults (words, and beginnings marked by `*`) with their weights, and the logistic curve."""

    insults: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -2.0

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """Finds the clauses that hold an insult or a threat and scores them."""

    def __init__(self, grammar: Grammar) -> None:
        self.insults = grammar.insults
        self.machine = machine()
        self.automaton = ahocorasick.Automaton()
        for entry in [*grammar.insults, *THREATS]:
            self.automaton.add_word(entry.rstrip("*"), len(entry.rstrip("*")))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weight(self, word: str) -> float | None:
        for key in (word, *(word[:n] + "*" for n in LENGTHS if len(word) >= n)):
            if key in self.insults:
                return self.insults[key]
        return None

    def symbols(self, text: str) -> tuple[str, list[float]]:
        """The symbols of a clause in lower case, and the strength of each."""
        found, strengths = [], []
        for word, comma, _ in TOKEN.findall(text):
            known = self.weight(word) if word else None
            if known is not None:
                symbol = "I"
            elif not word:
                symbol = "C" if comma else "Q"
            else:
                symbol = next((s for s, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("D", DETERMINERS), ("R", REPORTS)) if word in words), ".")
            found.append(symbol)
            strengths.append(known if known is not None else THREAT_WEIGHT if symbol == "H" else 0.0)
        return "".join(found), strengths

    def clause(self, text: str) -> float:
        """The weight of one clause in lower case."""
        return self.machine.best(*self.symbols(text))

    def document(self, text: str | None) -> float:
        """The sum over clauses; only those around a hit of the automaton are read as symbols."""
        if not text or not len(self.automaton):
            return 0.0
        text = text.lower()
        ends = [end for end, n in self.automaton.iter(text) if end - n < 0 or not text[end - n].isalpha()]
        total, done = 0.0, 0
        if not ends:
            return total
        bounds = [m.span() for m in CLAUSE.finditer(text)] + [(len(text), len(text))]
        begin, hits = 0, iter(ends)
        hit = next(hits)
        for stop, following in bounds:
            if hit is not None and begin <= hit < max(stop, begin + 1):
                total += self.clause(text[begin:stop])
                done += 1
                while hit is not None and hit < stop:
                    hit = next(hits, None)
            begin = following
            if hit is None:
                break
        return total


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Fit a grammar on at most `rows` labelled documents outside the held-out fold, chosen by hash order.

    The curve is fitted on fold 3 with a lexicon of folds 0 and 1; the lexicon is then made of all three. Candidates stay
    a table; what comes to the driver are the entries of the lexicon, which the words of at most `rows` documents bound.
    Rows without an id or label are not used; if there is no labelled toxic document, the grammar has the closed classes
    alone and its default curve.
    """
    labelled = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).where(fold(F.col(id)) != HELD_OUT)
    chosen = labelled.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # at most `rows` pairs of numbers
    known = docs.select(F.col(id).alias("__id"), whole(F.col(text)).alias("__t")).join(F.broadcast(chosen), "__id").where("__t <> ''")
    fitted = (fold(F.col("__id")) != 3).cast("int")
    known = known.select("__id", "__y", "__t", fitted.alias("__f"), F.split(F.lower("__t"), r"[^\p{L}]+").alias("__w"))
    keys = lambda w: F.array(w, *[F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in LENGTHS])
    sums = {"t": F.col("__y"), "c": 1 - F.col("__y"), "t_first": F.col("__y") * F.col("__f"), "c_first": (1 - F.col("__y")) * F.col("__f")}
    sizes = known.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sums.items()]).first()
    if not sizes["t"]:
        return Grammar()
    used = known.select("__y", F.explode(F.array_distinct(F.array_compact(F.flatten(F.transform(F.array_distinct("__w"), keys))))).alias("key")).where("key <> ''")
    candidates = used.groupBy("key").agg(F.sum("__y").alias("t"), F.sum(1 - F.col("__y")).alias("c")).where(F.expr("t >= 19 * c") & (F.col("t") >= support(sizes["t"], sizes["c"])))
    # Copies of one document say the same again: each text stands for one of the words that a candidate follows in it,
    # and what counts is how many different words that gives.
    after = known.select("__id", "__y", "__f", F.explode(F.transform("__w", lambda w, i: F.struct(keys(w).alias("keys"), F.xxhash64(F.get(F.col("__w"), i - 1)).alias("before")))).alias("x"))
    seen = after.select("__id", "__y", "__f", "x.before", F.explode("x.keys").alias("key")).join(candidates.select("key"), "key")
    texts = seen.groupBy("key", "__id", "__y", "__f").agg(F.min("before").alias("before"))
    contexts = texts.groupBy("key", "before").agg(*[F.max(v).alias(n) for n, v in sums.items()])
    counted = contexts.groupBy("key").agg(*[F.sum(n).alias(n) for n in sums])
    kept = [(F.col(t) >= support(sizes[t], sizes[c])) & (F.col(t) >= 19 * F.col(c)) for t, c in (("t", "c"), ("t_first", "c_first"))]
    found = counted.where(kept[0] | kept[1]).collect()  # the entries of both lexicons
    points = []
    if sizes["t_first"]:
        trial = Grammar(lexicon(found, sizes, "t_first", "c_first"))
        held = known.where(fold(F.col("__id")) == 3)
        points = summed(held.select("__y", "__t"), trial, "__t").select("__y", "total").collect()  # at most `rows` pairs
    grammar = Grammar(lexicon(found, sizes, "t", "c"))
    if {p["__y"] for p in points} == {0, 1}:
        grammar.slope, grammar.offset = logistic(np.array([p["total"] for p in points]), np.array([p["__y"] for p in points]))
    return grammar


def support(toxic: int, clean: int) -> int:
    """Toxic uses that an entry needs: of 100,000 words unrelated to the label, about one has so many and no clean one."""
    share = toxic / (toxic + clean) if toxic + clean else 1.0
    return max(4, math.ceil(math.log(1e5) / -math.log(min(share, 0.9))))


def lexicon(found: list, sizes, t: str, c: str) -> dict[str, float]:  # noqa: ANN001
    """Words and beginnings with their log-odds; an entry that a shorter beginning covers is left out."""
    least = support(sizes[t], sizes[c])
    insults: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["key"].rstrip("*")), r["key"])):
        word = r["key"].rstrip("*")
        if r[t] >= least and r[t] >= 19 * r[c] and not any(word[:n] + "*" in insults for n in LENGTHS if n <= len(word)):
            insults[r["key"]] = math.log((r[t] + 0.5) / (sizes[t] + 1)) - math.log((r[c] + 0.5) / (sizes[c] + 1))
    return insults


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of P(y = 1) over log(1 + x), by Newton's steps with a small ridge."""
    design = np.stack([np.log1p(x), np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) / len(y) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(y) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def summed(docs: DataFrame, grammar: Grammar, text: str) -> DataFrame:
    """`docs` with `total`, the sum of the clause scores of each whole text."""

    @F.pandas_udf("double")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = grammar.scanner()
        for batch in batches:
            yield batch.map(scanner.document).astype("float64")

    return docs.withColumn("total", total(F.col(text)))


def score(docs: DataFrame, grammar: Grammar, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, total), one row per row.

    A null or empty text has no clause, so its score is the foot of the curve; equal texts have equal scores. Repeated
    rows are scored one by one. Time and memory grow with the length of a text, not faster. Other columns are not read.
    """
    read = summed(docs.select(F.col(id).alias("doc_id"), whole(F.col(text)).alias("__t")), grammar, "__t")
    curve = 1 / (1 + F.exp(-(F.lit(grammar.slope) * F.log1p("total") + F.lit(grammar.offset))))
    scored = read.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), curve.alias("score"), "total")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "total")
