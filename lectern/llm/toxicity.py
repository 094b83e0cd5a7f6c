"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and every word becomes a symbol: a fixed class of words, or an insult with the
weight of its way through a trie. Three transducers read the symbols of a clause one after the other and
are composed into a single machine:

- negation marks the ``WINDOW`` symbols after a negating word;
- reported speech marks everything that follows a verb of saying;
- patterns match insults (plain, after a target, or with a target soon after) and threats, which take
  several words in order: somebody announces violence against a target, orders it, wishes a target dead
  or says that it deserves to be. A word of violence by itself matches nothing.

The heaviest path through the machine is a clause's reading; its weights go by context (plain, aimed,
negated, reported, threat). Only clauses score: a logistic layer turns sums over the matched clauses,
their number and the heaviest of them into a text's score.

The trie's insults are learned: words, and stems as their prefixes, that training documents labelled
toxic hold and others don't. The other classes are fixed lists. Trie and layer are fitted on ``SAMPLE``
labelled rows of each class at most (those of least hash) among the rows that may be learned from; the
layer learns from clause sums that a trie of the other half has produced. The trie holds every entry that
the sample supports. Label, language, source and id are never inputs.

Defined cases: a null or empty text has no clause and scores by the bias alone; texts are read whole,
clause by clause; rows of one id keep one label, the larger, and learn from the least of their texts;
repeated documents give repeated rows; without labels of both classes the fixed patterns alone score; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, map_rows, text_of
from lectern.llm.transducers import Machine, Trie, best_path, compose

THRESHOLD, SAMPLE = 0.3, 2_500
STEMS = range(3, 9)
#: Least toxic documents that a trie entry needs (and one in RARITY of those read), least log-odds.
SUPPORT, RARITY, ODDS = 5, 100, 2.5
WINDOW = 3

# Fixed lists of the grammar's closed classes, four languages together.
CLASSES = {
    "violent": "kill murder stab strangle shoot hurt beat smash punch choke töten umbringen erschießen schlagen tuer frapper étrangler matar golpear apuñalar",
    "struck": "matarte matarlo matarla matarlos golpearte",  # violence and target in one word
    "death": "die dies dead suffer burn rot sterben stirb mourir crève morir muere",
    "target": "you your yours u they he she him them du dich dein euch ihr tu toi te vous ton tú ti usted ustedes tus",
    "self": "i i'm i'd we we're we'd someone somebody ich wir je nous yo nosotros",
    "intent": "will shall gonna going want should would must werde werden wollen vais allons veux voy vamos quiero",
    "vow": "i'll we'll",  # somebody and intent in one word
    "deserve": "deserve deserves deserved ought verdienst mérites mereces",
    "wish": "hope wish hoffe espère espero ojalá",
    "not": "not no never isn't aren't don't won't nicht kein keine nie pas jamais ne nunca jamás",
    "report": "said says wrote claimed called quoted reported sagte schrieb dit écrit dijo escribió",
}
TAG = {w: tag for tag, words in CLASSES.items() for w in words.split()}
TAGS = ("word", "insult", *CLASSES)
NEGATED_MARK, REPORTED_MARK = "!", "~"

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PLAIN, NEGATED, REPORTED, AIMED, THREAT = range(5)
#: Weight of a matched threat, and what a context leaves of a weight.
MENACE, CONTEXT = 4.0, {PLAIN: 1.0, NEGATED: 0.25, REPORTED: 0.5, AIMED: 1.25, THREAT: 1.0}


def negation() -> Machine:
    """Reads symbols, writes them marked for ``WINDOW`` symbols after a negating one."""
    m = Machine()
    steps = [0, *(m.state() for _ in range(WINDOW))]  # how many symbols are left to mark
    m.final = set(steps)
    for left, here in enumerate(steps):
        for tag in TAGS:
            after = WINDOW if tag == "not" else max(0, left - 1)
            m.arc(here, tag, steps[after], tag + NEGATED_MARK * (left > 0))
    return m


def reported_speech() -> Machine:
    """Reads symbols, writes them marked after a verb of saying, up to the clause's end."""
    m = Machine()
    m.final = {0, (told := m.state(True))}
    for mark in ("", NEGATED_MARK):
        for tag in TAGS:
            m.arc(0, tag + mark, told if tag == "report" else 0, tag + mark)
            m.arc(told, tag + mark, told, tag + mark + REPORTED_MARK)
    return m


def patterns() -> Machine:
    """Reads marked symbols, writes the context of what they match."""
    m = Machine()
    marks = [n + r for n in ("", NEGATED_MARK) for r in ("", REPORTED_MARK)]

    def link(source: int, tags: tuple[str, ...], target: int, context: int | None = None, weight: float = 1.0) -> None:
        for tag in tags:
            for mark in marks:
                told = context if context is None else REPORTED if REPORTED_MARK in mark else NEGATED if NEGATED_MARK in mark else context
                m.arc(source, tag + mark, target, told, 0.0 if told is None else weight * CONTEXT[told])

    def after(source: int, gap: int, tags: tuple[str, ...], target: int, context: int | None = None, weight: float = 1.0) -> None:
        """``tags`` follow with up to ``gap`` other symbols between."""
        link(source, tags, target, context, weight)
        for _ in range(gap):
            link(source, TAGS, source := m.state())
            link(source, tags, target, context, weight)

    open_, aimed = m.state(True), m.state(True)
    m.final |= {0}
    for here in (0, open_, aimed):
        known = aimed if here == aimed else open_
        link(here, tuple(t for t in TAGS if t not in ("insult", "target")), known)
        link(here, ("target",), aimed)
        link(here, ("insult",), known, AIMED if here == aimed else PLAIN)
        # An insult that its target follows: the path dies unless the target comes.
        link(here, ("insult",), (pending := m.state()), AIMED)
        after(pending, 2, ("target",), aimed)
        # Somebody announces it: "I will (soon) kill all of you", "ich werde dich töten", "I'll kill you".
        link(here, ("self",), (someone := m.state()))
        after(someone, 1, ("intent",), (set_ := m.state()))
        link(here, ("vow",), set_)
        link(here, ("intent",), (bare := m.state()))  # "voy a matarte"
        after(bare, 2, ("struck",), aimed, THREAT, MENACE)
        after(set_, 2, ("struck",), aimed, THREAT, MENACE)
        after(set_, 2, ("violent",), (struck := m.state()))
        after(struck, 2, ("target",), aimed, THREAT, MENACE)
        after(set_, 2, ("target",), (faced := m.state()))
        after(faced, 2, ("violent",), aimed, THREAT, MENACE)
        # Wishes it, or finds it deserved: "I hope they die", "you deserve to die", "he should be dead".
        link(here, ("wish",), (wished := m.state()))
        after(wished, 2, ("target",), (blessed := m.state()))
        after(blessed, 2, ("death", "violent"), aimed, THREAT, MENACE)
        link(here, ("target",), (judged := m.state()))
        after(judged, 1, ("deserve", "intent"), (due := m.state()))
        after(due, 2, ("death",), aimed, THREAT, MENACE)
    # Orders it, at the clause's start: "kill them all".
    link(0, ("violent",), (order := m.state()))
    after(order, 1, ("target",), aimed, THREAT, MENACE)
    return m


@lru_cache(1)
def composed() -> Machine:
    return compose(compose(negation(), reported_speech()), patterns())


#: Symbols that can make a clause match, with others or alone.
LIVE = frozenset(("insult", "violent", "struck", "death"))


class Grammar:
    """The composed transducers. ``insults`` maps a word ("idiot$") or a stem ("idio") to its weight."""

    def __init__(self, insults: dict[str, float]):
        self.trie, self.machine = Trie(insults), composed()
        self._known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's class and weight; the fixed classes come first."""
        if (got := self._known.get(word)) is None:
            if len(self._known) > 300_000:
                self._known.clear()
            if (tag := TAG.get(word)) is None:
                weight = self.trie.weight(word)
                got = ("insult", weight) if weight else ("word", 1.0)
            else:
                got = tag, 1.0
            self._known[word] = got
        return got

    def clause(self, words: list[str]) -> tuple[float, ...]:
        """Matched weight by context of one clause: its heaviest reading."""
        symbols = [*map(self.symbol, words)]
        if not any(s in LIVE for s, _ in symbols):
            return (0.0,) * 5
        return best_path(self.machine, symbols, 5)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Sums over the text's matched clauses: weight by context, their number, the heaviest one."""
        sums, clauses, heaviest = np.zeros(5), 0, 0.0
        for part in _CLAUSE.split((text or "").lower()):
            found = self.clause(_WORD.findall(part))
            if any(found):
                sums += found
                clauses += 1
                heaviest = max(heaviest, sum(found))
        return (*np.log1p(sums), np.log1p(clauses), min(1.0, clauses / 2), np.log1p(heaviest), np.log1p(sums.sum()))


FEATURES = 9


def entries(text: str | None) -> set[str]:
    """Trie entries that a document speaks for: its words and their stems."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add(f"{w}$")
        out.update(w[:k] for k in STEMS if k < len(w))
    return out


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the entries worth keeping: shortest stems first, longer ones only if they say more."""
    out: dict[str, float] = {}
    scored = []
    for entry, bad, good in counts:
        odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (clean + 1))
        if bad >= max(SUPPORT, toxic // RARITY) and odds >= ODDS and bad * clean >= 4 * good * toxic:
            scored.append((round(float(odds), 3), bad, entry))
    for odds, bad, entry in sorted(scored, key=lambda x: (-x[1], len(x[2]), x[2])):
        stems = [entry[:k] for k in STEMS if k < len(entry)]
        if any(out.get(s, 0.0) >= odds for s in stems):
            continue
        out[entry] = odds
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weighted, slightly damped logistic regression by Newton's steps; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    damp = np.r_[np.full(x.shape[1] - 1, decay), 1e-6]
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + damp * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(damp)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


class Model:
    """A trie of bounded size and the layer's coefficients."""

    def __init__(self, insults: dict[str, float], layer: np.ndarray):
        self.insults, self.layer = insults, layer

    def scorer(self):
        grammar, w, b = Grammar(self.insults), self.layer[:-1], self.layer[-1]
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.dot(grammar.features(text), w) + b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows whose id isn't held out."""
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.filter(F.coalesce(~held_out(F.col("doc_id")), F.lit(False))).withColumn("toxic", (F.col("toxic") >= 1).cast("int"))
    given = given.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    totals = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    flat = Model({}, np.r_[np.zeros(FEATURES - 1), 1.0, -2.0])
    if len(totals) < 2:
        return flat
    sides = [given.filter(F.col("toxic") == side).orderBy("h", "doc_id").limit(sample) for side in (0, 1)]
    chosen = sides[0].unionByName(sides[1]).withColumn("half", F.pmod(F.shiftright("h", 7), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id"), text_of().alias("text"))
    # Twice SAMPLE rows at most go to every task; of an id's texts the least counts.
    rows = checkpointed(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text")).select("text", "toxic", "half"))
    taken = {(r.toxic, r.half): r.n for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if {t for t, _ in taken} != {0, 1}:
        return flat

    def list_entries():
        return lambda text, toxic, half: [(e, toxic, half) for e in entries(text)]

    n = lambda t, h: F.sum(((F.col("toxic") == t) & (F.col("half") == h)).cast("long")).alias(f"n{t}{h}")
    listed = map_rows(rows.select("text", "toxic", "half"), list_entries, "entry string, toxic int, half int", flat=True)
    sums = listed.groupBy("entry").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    size = lambda t, *halves: sum(taken.get((t, h), 0) for h in halves)
    bad, good = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    # A trie of a half or of the whole needs this much at least; the sample bounds what passes.
    least = max(SUPPORT, min(size(1, 0), size(1, 1)) // RARITY)
    counts = sums.filter((bad >= least) & (bad * size(0, 0, 1) >= good * size(1, 0, 1))).collect()
    of_half = lambda h: choose([(r.entry, r[f"n1{h}"], r[f"n0{h}"]) for r in counts], size(1, h), size(0, h))
    tries = [of_half(1), of_half(0)]  # each half is read with the other half's trie
    whole = choose([(r.entry, r.n10 + r.n11, r.n00 + r.n01) for r in counts], size(1, 0, 1), size(0, 0, 1))

    def measure():
        grammars = [Grammar(t) for t in tries]
        return lambda text, toxic, half: (toxic, [float(v) for v in grammars[half].features(text)])

    got = map_rows(rows.select("text", "toxic", "half"), measure, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in got], float)
    weight = np.where(y > 0, totals[1] / max(1, size(1, 0, 1)), totals[0] / max(1, size(0, 0, 1)))
    return Model(whole, fit(np.array([r.x for r in got]), y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's rows, by one narrow pass."""
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_of())

    def make():
        one = model.scorer()

        def row(key, held, text):
            s = one(text)
            return key, held, s, int(s >= THRESHOLD)

        return row

    return map_rows(source, make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
