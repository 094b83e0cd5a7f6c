"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are named masks over those bits, so a policy change or an ablation never reads a text
again. All of it is narrow but for the ablation counts, which aggregate the distinct bit patterns
(2 ** number of rules at most).

Defined cases: a null text counts as empty (no words, so ``few_words`` fails); a text of any length is
measured whole; repeated rows give repeated ledger rows; an empty table gives an empty ledger; extra
columns are ignored or, in ``filter_documents``, kept, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, map_rows, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bit positions of the ledger; a rule keeps its bit for good.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "stutter", "word_length", "shouting")
BASE_MASK = 0b0000011
#: Versioned policies: the rules that reject.
POLICIES = {"base": BASE_MASK, "v1": 0b1111111}

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stutter long, n_shout long"
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT, MAX_STUTTER_PCT, MAX_WORD_LENGTH, MAX_SHOUT_PCT = 20, 30, 20, 50, 50, 20, 30

_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a ``window``-word window that occurs at least twice, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[str, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.uint64, len(words))
    if len(first) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * _MIX
    ids ^= ids >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for i in range(window):
        keys = keys * np.uint64(0xD1342543DE82EF95) + ids[i : i + n]
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal keys
    seen = Counter(windows := [tuple(words[i : i + window]) for i in range(n)])
    edges = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measurer():
    find = re.compile(WORD).findall
    has = re.compile(WORD).search

    def measure(text: str | None) -> tuple:
        text = text or ""
        words = find(text)
        seen: set[str] = set()
        lines = dup = 0
        for line in text.split("\n"):
            if has(line):
                lines += 1
                dup += line in seen
                seen.add(line)
        stutter = sum(map(str.__eq__, words, words[1:]))
        shout = sum(1 for w in words if w.endswith("!!"))
        return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines, stutter, shout

    return measure


def failure_bits():
    """One bit per rule, from integer measurements only."""
    words, per = F.col("n_words"), 100
    failed = (
        words < MIN_WORDS,
        per * F.col("n_repeat_words") > MAX_REPEAT_PCT * words,
        per * F.col("n_symbols") > MAX_SYMBOL_PCT * words,
        per * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"),
        per * F.col("n_stutter") > MAX_STUTTER_PCT * words,
        F.col("word_chars") > MAX_WORD_LENGTH * words,
        per * F.col("n_shout") > MAX_SHOUT_PCT * words,
    )
    bits = F.lit(0).cast("long")
    for i, f in enumerate(failed):
        bits = bits.bitwiseOR(F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` of every row."""
    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, {MEASURES}"

    def make():
        measure = measurer()
        return lambda key, text: (key, *measure(text))

    return map_rows(docs.select(F.col(id_column), text_of(text_column).alias("_text")), make, schema).withColumn("failed_bits", failure_bits())


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept``: no rule of the policy fails."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows failing it, rows failing it alone, and rows kept without it."""
    mask = POLICIES[policy]
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1]
    each = patterns.select("bits", "n", F.inline(F.array(*rules)))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("n_failed"), total(only)("n_only"), total(only | (F.col("bits") == 0))("n_kept_without"))


def quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The contract's rows: measurements, the base verdict and the policy's."""
    rows = apply_policy(ledger(docs), policy)
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits")


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``.

    A row travels through the measuring step whole, so no join brings its text back.
    """
    places = [f"_{i}" for i in range(len(docs.columns))]
    source = docs.select(*(F.col(c).alias(p) for c, p in zip(docs.columns, places)), text_of().alias("text"))
    schema = ", ".join([*(f"{p} {t}" for p, (_, t) in zip(places, docs.dtypes)), MEASURES])

    def make():
        measure = measurer()
        return lambda *row: (*row[:-1], *measure(row[-1]))

    rows = apply_policy(map_rows(source, make, schema).withColumn("failed_bits", failure_bits()), policy)
    return rows.filter("kept").select(*(F.col(p).alias(c) for c, p in zip(docs.columns, places)))


def ablation_rows(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does to a table, from one ledger."""
    return ablation(ledger(docs), policy)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS r FROM documents
), pos AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w
), win AS (
  SELECT r, i, n, word, lead(word, 1) OVER o AS nx,
    CASE WHEN i + 7 <= n THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS k
  FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)
), rep AS (
  SELECT r, i, word, nx, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1 THEN 1 ELSE 0 END AS f FROM win
), cov AS (
  SELECT r, word, nx, max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM rep
), wordly AS (
  SELECT r, sum(c) AS n_repeat_words, sum(CASE WHEN word = nx THEN 1 ELSE 0 END) AS n_stutter, sum(length(word)) AS word_chars,
    sum(CASE WHEN word LIKE '%!!' THEN 1 ELSE 0 END) AS n_shout FROM cov GROUP BY r
), line AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM w
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_stutter, 0) AS n_stutter, coalesce(n_shout, 0) AS n_shout
  FROM w LEFT JOIN wordly USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * n_stutter > 50 * n_words)::BIGINT
    + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (100 * n_shout > 30 * n_words)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM b
"""
