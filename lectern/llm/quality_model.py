"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Their votes are counted
by pattern over the whole corpus, and expectation-maximisation on those counts (at most 3 to the
number of labellers, whatever the corpus) estimates each labeller's vote probabilities in both classes.
The posterior of a document's pattern is its label. A linear scorer over hashed words, word shapes and
repetitions learns these labels and scores every whole text.

Only the scorer's weights are fitted on a sample: ``SAMPLE`` documents of each posterior class at most,
those of least hash, weighted back to the classes' counts over the whole corpus.

Labellers read every text once; their votes are written as numbers, which serve the counts, the choice
of the sample and the rows' weak labels.

Defined cases: a null or empty text gets every labeller's abstention and scores by the bias alone; texts
are read whole, whatever their length; repeated rows give repeated rows; rows of the sample with equal
hashes are ordered by their content; with an empty table or one class only, the posterior's share is the
score; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, checkpointed, map_rows, row_key, text_of

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("length", "symbols", "stutter", "case", "variety", "endings", "word_length", "letters", "tails", "bare")
BUCKETS, SAMPLE, KEEP = 1 << 12, 2_000, 0.5
_SYMBOLS = frozenset(r"#*$%&|<>{}\~^_=+")
_LETTER = re.compile(r"[^\W\d_]")
_TAIL = re.compile(r"[^\w\s]{2}$")
_ENDS = frozenset(".!?…:;\"')]»”")
_WORDS = re.compile(WORD).findall
#: Words whose facts a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 300_000


class Words(dict):
    """Facts of words by ``make``, made once each."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = self._make(word)
        return got


def _kind(word: str) -> int:
    """1: without a letter; 2: ends in two signs; 3: both."""
    return (not _LETTER.search(word)) + 2 * bool(_TAIL.search(word))


def voter():
    """The labellers, as a function of a text and its words. Each rule looks at its own evidence and may abstain."""
    kinds = Words(_kind)
    three = lambda bad, good: BAD if bad else GOOD if good else NONE

    def votes(text: str, words: list[str]) -> tuple[int, ...]:
        n = len(words)
        if not n:
            return (NONE,) * len(LABELLERS)
        letters = upper = symbols = 0
        for c, k in Counter(text).items():
            if c.isalpha():
                letters += k
                upper += k if c.isupper() else 0
            elif c in _SYMBOLS:
                symbols += k
        stutter = sum(map(str.__eq__, words, words[1:]))
        distinct = len(set(words))
        lines = [x for x in text.split("\n") if x.strip()]
        ended = sum(1 for x in lines if x.rstrip()[-1] in _ENDS)
        chars = sum(map(len, words))
        found = Counter(map(kinds.__getitem__, words))
        bare, tails = found[1] + found[3], found[2] + found[3]
        return (
            three(False, n >= 20),
            three(symbols > 0.15 * n, symbols <= 0.02 * n),
            three(stutter > 0.2 * n, stutter <= 0.02 * n),
            three(upper > 0.5 * letters and n > 3, upper < 0.2 * letters),
            three(n >= 50 and distinct < 0.2 * n, distinct > 0.4 * n or n < 50),
            three(n >= 20 and not ended, ended >= 0.5 * len(lines)),
            three(chars > 14 * n, 2 * n <= chars <= 10 * n),
            three(letters < 0.7 * chars, letters > 0.85 * chars),
            three(tails > 0.15 * n, tails <= 0.03 * n),
            three(bare > 0.15 * n, bare <= 0.05 * n),
        )

    return votes


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, P(vote | class) as [class, labeller, vote], and the share of good.

    Starts from the patterns without a bad vote as good. One pseudo-document per vote keeps
    probabilities off zero.
    """
    hit = np.stack([(patterns == v) for v in (BAD, GOOD, NONE)], 2).astype(float)
    good = np.where((patterns == BAD).any(1), 0.1, 0.95)
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * counts
        share = (both.sum(1) + 1) / (counts.sum() + 2)
        table = (np.einsum("cp,plv->clv", both, hit) + 1) / (both.sum(1)[:, None, None] + 3)
        log = np.einsum("plv,clv->cp", hit, np.log(table)) + np.log(share)[:, None]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return good, table, float(share[1])


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % BUCKETS


def shape(word: str) -> str:
    """Classes of a word's characters, runs shortened."""
    if word.isalpha() and (word.islower() or word[1:].islower() and word[0].isupper()):
        tail = len(word) - (not word.islower())
        return ("" if word.islower() else "A") + ("a+" if tail > 1 else "a")
    return re.sub(r"(.)\1+", r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    return _hash("w" + word.lower()), _hash("s" + shape(word))


REPEAT, AGAIN = _hash("next word is the same"), _hash("word seen before")


def vector(text: str | None) -> dict[int, float]:
    """Bucket shares of a whole text."""
    words = _WORDS(text or "")
    out: dict[int, float] = {}
    for w in words:
        for b in features(w):
            out[b] = out.get(b, 0) + 1
    out[REPEAT] = out.get(REPEAT, 0) + sum(map(str.__eq__, words, words[1:]))
    out[AGAIN] = out.get(AGAIN, 0) + len(words) - len(set(words))
    return {b: c / max(1, len(words)) for b, c in out.items()}


class Sparse:
    """Rows of few buckets each, as (row, bucket, value) triples."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int = BUCKETS):
        self.shape = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
        self.column = np.array([c for b, _ in rows for c in b], np.int64)
        self.value = np.array([v for _, x in rows for v in x], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.shape[0])

    def turned_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * e[self.row], minlength=self.shape[1])


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels, by gradient steps with per-bucket scaling."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    squares, bias_square = np.zeros_like(w), 0.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - y) * weight
        g, gb = x.turned_times(error) + decay * w, error.sum()
        squares += g * g
        bias_square += gb * gb
        w -= 1.0 * g / (np.sqrt(squares) + 1e-8)
        b -= 0.3 * gb / (np.sqrt(bias_square) + 1e-8)
    return w, b


def vote_code(v: tuple[int, ...]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``row_id, doc_id, text``: rows of one id and text share a 128-bit ``row_id``."""
    text = text_of(text_column)
    return docs.select(row_key(F.col(id_column), text).alias("row_id"), F.col(id_column).alias("doc_id"), text.alias("text"))


def labelled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row_id, doc_id, code``: the vote pattern of every row, as a number."""
    source = _keyed(docs, id_column, text_column)

    def make():
        votes = voter()
        return lambda row, key, text: (row, key, vote_code(votes(text, _WORDS(text))))

    return map_rows(source, make, f"row_id string, doc_id {dict(source.dtypes)['doc_id']}, code int")


class Model:
    """Posteriors by pattern and the scorer's weights: bounded by labellers and buckets alone."""

    def __init__(self, posterior: dict[int, float], table: np.ndarray, share: float, weights: np.ndarray, bias: float):
        self.posterior, self.table, self.share, self.weights, self.bias = posterior, table, share, weights, bias

    def accuracies(self) -> dict[str, float]:
        """How often each labeller that votes is right, by the model."""
        right = self.table[0, :, BAD] * (1 - self.share) + self.table[1, :, GOOD] * self.share
        wrong = self.table[0, :, GOOD] * (1 - self.share) + self.table[1, :, BAD] * self.share
        return dict(zip(LABELLERS, right / (right + wrong)))

    def scorer(self):
        """The score of a list of words."""
        weights, bias = self.weights.tolist(), self.bias
        known = Words(lambda w: sum(weights[b] for b in features(w)))

        def score(words: list[str]) -> float:
            total = sum(map(known.__getitem__, words)) + weights[REPEAT] * sum(map(str.__eq__, words, words[1:])) + weights[AGAIN] * (len(words) - len(set(words)))
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, total / max(1, len(words)) + bias))))

        return score


def train(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", votes: DataFrame | None = None) -> Model:
    """The model of a corpus. ``votes`` are its rows of ``labelled``, if they are at hand."""
    votes = checkpointed(labelled(docs, id_column, text_column)) if votes is None else votes
    counts = votes.groupBy("code").agg(F.count("*").alias("n")).collect()
    codes, n = np.array([r.code for r in counts], np.int64), np.array([r.n for r in counts], float)
    patterns = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good, table, share = expectation_maximisation(patterns.reshape(-1, len(LABELLERS)), n)
    posterior = {int(c): float(g) for c, g in zip(codes, good)}
    if not min(n[good >= 0.5].sum(), n[good < 0.5].sum()):
        return Model(posterior, table, share, np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))

    # The rows of least hash of each class; only they are read again.
    def picked(is_good: bool) -> DataFrame:
        of_class = votes.filter(F.col("code").isin([int(c) for c in codes[(good >= 0.5) == is_good]]))
        return of_class.select("row_id", "code").orderBy(F.xxhash64(F.lit("fit"), "row_id"), "row_id").limit(sample)

    chosen = picked(False).unionByName(picked(True)).groupBy("row_id").agg(F.first("code").alias("code"), F.count("*").alias("copies"))
    chosen = [tuple(r) for r in chosen.collect()]
    kept = docs.sparkSession.createDataFrame(chosen, "row_id string, code int, copies long")
    source = _keyed(docs, id_column, text_column).join(F.broadcast(kept), "row_id").dropDuplicates(["row_id"])

    def make():
        def row(key, code, copies, text):
            v = vector(text)
            return key, code, copies, list(v), list(v.values())

        return row

    rows = map_rows(source.select("row_id", "code", "copies", "text"), make, "row_id string, code int, copies long, b array<int>, x array<double>").collect()
    rows.sort(key=lambda r: r.row_id)
    y = np.array([posterior[r.code] for r in rows])
    copies = np.array([r.copies for r in rows], float)
    total = {side: n[(good >= 0.5) == side].sum() / copies[(y >= 0.5) == side].sum() for side in (False, True)}
    w, b = fit(Sparse([(r.b, r.x) for r in rows]), y, copies * np.where(y >= 0.5, total[True], total[False]))
    return Model(posterior, table, share, w, b)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", votes: DataFrame | None = None) -> DataFrame:
    """``doc_id, score, weak_label, kept`` for every row, by one pass over texts; weak labels come from their written votes."""
    votes = labelled(docs, id_column, text_column) if votes is None else votes
    source = _keyed(docs, id_column, text_column)

    def make():
        one = model.scorer()
        return lambda row, key, text: (row, key, one(_WORDS(text)))

    scored = map_rows(source, make, f"row_id string, doc_id {dict(source.dtypes)['doc_id']}, score double")
    # At most one row per pattern of votes: bounded by the number of labellers.
    known = docs.sparkSession.createDataFrame(list(model.posterior.items()), "code int, weak_label double")
    labels = votes.select("row_id", "code").dropDuplicates(["row_id"]).join(F.broadcast(known), "code", "left")
    return scored.join(labels, "row_id").select("doc_id", "score", "weak_label", (F.col("score") >= KEEP).alias("kept"))


def quality_rows(docs: DataFrame) -> DataFrame:
    votes = checkpointed(labelled(docs))
    return score(docs, train(docs, votes=votes), votes=votes)
