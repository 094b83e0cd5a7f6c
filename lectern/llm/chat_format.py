"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the turns to learn from are found
among the token spans by binary search. The template marks each turn with three control tokens,

    <|turn|>role<|text|>text<|end|>

so a text's ends are token ends. Control strings inside roles and texts, those of other common
templates included, get a backslash behind their first character, and one more if backslashes already
stand there, which can be undone exactly. The query reads everything back from what was rendered and
from the tokens' offsets, in the same pass.

Token spans are exact in bytes; a token that starts or ends inside a character takes in all of it. The
only shuffle gathers each conversation's turns; a conversation is rendered in one piece, so its length
bounds a task's memory.

Defined cases: a null text or role counts as empty; turns with the same number come in order of role,
then text; repeated rows are turns of their own; rows without a conversation id form one conversation;
an empty table leaves the added conversation only; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The conversation that the query adds: its texts are control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_RENDERED = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the learned texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


@lru_cache(2)
def tokenizer(vocabulary: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A rank file's tokenizer with the template's control tokens, and each token's length in bytes."""
    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    first = max(ranks.values()) + 2  # one id is left free for an end of text
    special = {c: first + i for i, c in enumerate((TURN, TEXT, END))}
    sizes = np.zeros(first + len(special), np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    for token, rank in special.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), sizes


def encode(formatted: str, spans: list[tuple[int, int]], vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, their starts and ends in code points, and the loss mask."""
    encoding, sizes = tokenizer(vocabulary)
    ids = np.array(encoding.encode(formatted, allowed_special="all"), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if not formatted.isascii():
        raw = np.frombuffer(formatted.encode(), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts, ends = point[starts], point[ends - 1] + 1
    mask = np.zeros(len(ids), bool)
    if spans:
        for first, last in np.searchsorted(starts, np.array(spans), "left"):
            mask[first:last] = True
    return ids, starts, ends, mask


def masked_texts(formatted: str, starts, ends, mask) -> list[str]:
    """What lies under the mask, one string for each run of learned tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, np.int8), 0]))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2])]


def digests(formatted: str, starts, ends, mask) -> tuple:
    """The contract's columns, from a formatted conversation and its tokens alone."""
    turns = [(unescape(r), unescape(x)) for r, x in _RENDERED.findall(formatted)]
    learned = "".join(masked_texts(formatted, starts, ends, mask))
    said = "".join(f"{r}\n{x}\n" for r, x in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def gathered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order."""
    row = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    return turns.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY, learned: str = LEARNED, **columns: str) -> DataFrame:
    """``conv_id, formatted, token_ids, starts, ends, loss_mask`` for each conversation."""
    whole = gathered(turns, **columns)

    def make():
        def one(key, rows):
            formatted, spans = render([(r["r"], r["x"]) for r in rows], learned)
            return (key, formatted, *(x.tolist() for x in encode(formatted, spans, vocabulary)))

        return one

    return map_rows(whole, make, f"conv_id {dict(whole.dtypes)['conv_id']}, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>")


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests of what ``format_conversations`` returned."""
    kind = dict(formatted.dtypes)["conv_id"]
    columns = ("conv_id", "formatted", "starts", "ends", "loss_mask")
    return map_rows(formatted.select(*columns), lambda: lambda key, *rest: (key, *digests(*rest)), f"conv_id {kind}, {DIGESTS}")


def chat_rows(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The contract's rows: all conversations, and the one that consists of control strings."""
    columns = ("conv_id", "turn", "role", "text")
    kinds = dict(conversations.dtypes)
    probe = conversations.sparkSession.createDataFrame(PROBE, ", ".join(f"{c} {kinds[c]}" for c in columns))

    def make():
        def one(key, rows):
            formatted, spans = render([(r["r"], r["x"]) for r in rows])
            return key, *digests(formatted, *encode(formatted, spans, vocabulary)[1:])

        return one

    return map_rows(gathered(conversations.select(*columns).unionByName(probe)), make, f"conv_id {kinds['conv_id']}, {DIGESTS}")


def _oracle() -> str:
    pattern = rf"([<\[])(\\*)({_TAILS})".replace("'", "''")
    rows = ", ".join(f"({c}::BIGINT, {t}::BIGINT, '{r}', '{x}')" for c, t, r, x in PROBE)
    escaped = lambda c: f"regexp_replace({c}, '{pattern}', '\\1\\\\\\2\\3', 'g')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT * FROM (VALUES {rows}) AS p(conv_id, turn, r, x)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  sum(CASE WHEN r = '{LEARNED}' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN r = '{LEARNED}' THEN x ELSE '' END, '' ORDER BY turn, r, x)) AS loss_sha256,
  sum({len(TURN + TEXT + END)} + length({escaped('r')}) + length({escaped('x')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLE = _oracle()
