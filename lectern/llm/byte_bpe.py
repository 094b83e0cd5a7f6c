"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to one chunk are encoded where they are read: no shuffle. Longer texts become chunk rows that
overlap; each chunk is pre-tokenised on its own, wherever it lies. A pre-token depends only on what
follows its start, so once two neighbouring chunks have a pre-token boundary in common, the later
chunk's boundaries are the right ones from there on. The chunks of a text are stitched at such
boundaries, then the pieces are encoded, one text at a time.

Defined cases: a null text counts as empty and encodes to no ids; rows that agree in id and text each
give one row; an empty table gives no rows; extra columns are ignored; a text whose chunks never
resynchronise (one endless pre-token, say) is pre-tokenised on from its last sure boundary.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 16_384, 256
#: Pieces whose ids a worker remembers, about 15 MB; beyond that it forgets all and starts again.
REMEMBERED = 50_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes pieces and decodes ids by one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self._one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._bytes = {b: a for a, b in ranks.items()}
        self._known: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: Iterable[str]) -> list[int]:
        known, one = self._known, self._one
        ids: list[int] = []
        for piece in pieces:
            if (got := known.get(piece)) is None:
                got = tuple(one(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@lru_cache(2)
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """One codec per worker process; a name without a slash is a public tokenizer's file."""
    return Codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk, then the end of the last one that more text can't change.

    Unless the chunk is its text's last one, a match that touches the chunk's end could go on, and the
    one before could be shortened by the pattern's look-ahead; both are left to the next chunk.
    """
    starts = [m.start() for m in pattern.finditer(text)]
    return [*starts, len(text)] if last else starts[:-1]


def stitch(chunks: list[tuple[int, str, list[int]]], pattern: regex.Pattern) -> Iterator[str]:
    """Pieces of a text from its chunks ``(start, text, boundaries)``, in order of start."""
    starts = [c[0] for c in chunks]
    full = "".join(text[: after - start] for (start, text, _), after in zip(chunks, [*starts[1:], 1 << 62]))
    cuts = [[start + c for c in own] for start, _, own in chunks]
    at = 0  # the sure boundary reached so far
    for k, own in enumerate(cuts):
        inside = set(own)
        if at not in inside:  # out of step: go on from the sure boundary until this chunk has it too
            for m in pattern.finditer(full, at):
                if at in inside or not own or at > own[-1]:
                    break
                yield m.group()
                at = m.end()
        if at not in inside:
            continue
        later = set(cuts[k + 1]) if k + 1 < len(cuts) else ()
        for a, b in zip(own[(i := bisect_left(own, at)) :], own[i + 1 :]):
            if a in later:
                break
            yield full[a:b]
            at = b
    for m in pattern.finditer(full, at):
        yield m.group()


def digest(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _chunk_rows(key, text: str, chunk: int, overlap: int) -> Iterator[tuple]:
    whole = hashlib.sha256(text.encode()).digest()
    starts = range(0, max(1, len(text)), chunk)
    for n, s in enumerate(starts):
        yield key, whole, n, n + 1 == len(starts), s, text[s : s + chunk + overlap]


def _encode_chunks(rows: Iterator[pa.RecordBatch], vocabulary: str, schema: pa.Schema, finish) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, text digest, number): one text is held at a time."""
    c = codec(vocabulary)

    def texts():
        group, at = [], None
        for batch in rows:
            for i in range(0, batch.num_rows, 64):
                for key, whole, n, _last, start, text, cuts in zip(*(x.to_pylist() for x in batch.slice(i, 64).columns)):
                    if (key, whole) != at:
                        if group:
                            yield at[0], group
                        group, at = [], (key, whole)
                    group.append((start, text, list(np.frombuffer(cuts, "<i4"))))
        if group:
            yield at[0], group

    for key, group in texts():
        # Repeated rows bring each chunk as often as the text occurs.
        distinct = [x for i, x in enumerate(group) if not i or x[0] != group[i - 1][0]]
        ids = c.encode_pieces(stitch(distinct, c.pattern))
        out = [(key, *finish(c, ids))] * (len(group) // len(distinct))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, ids: bool = False) -> DataFrame:
    """One row per document: its id, the number of tokens and digests of ids and decoded bytes.

    With ``ids``, the ids themselves come as ``token_ids array<int>`` too.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, {RESULT}" + ", token_ids array<int>" * ids
    source = docs.select(F.col(id_column).alias("_key"), text_of(text_column).alias("_text"))
    short = F.length("_text") <= chunk + overlap

    def finish(c: Codec, got: list[int]) -> tuple:
        return (*digest(got, c.decode(got)), *([got] if ids else []))

    def whole():
        c = codec(vocabulary)
        return lambda key, text: (key, *finish(c, c.encode(text)))

    def pretokenise():
        pattern = codec(vocabulary).pattern

        def row(key, text):
            for *head, last, start, part in _chunk_rows(key, text, chunk, overlap):
                yield *head, last, start, part, np.array(boundaries(part, pattern, last), "<i4").tobytes()

        return row

    one = map_rows(source.filter(short), whole, schema)
    cut = map_rows(source.filter(~short), pretokenise, f"_key {kind}, _whole binary, _n int, _last boolean, _start long, _text string, _cuts binary", flat=True)
    cut = cut.repartition(F.col("_key"), F.col("_whole")).sortWithinPartitions("_key", "_whole", "_n")
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(shape)
    many = cut.mapInArrow(lambda rows: _encode_chunks(rows, vocabulary, arrow, finish), shape)
    return one.unionByName(many)


def decode_column(column: str, vocabulary: str = VOCABULARY):
    """The raw bytes of an ``array<int>`` column of ids, as an Arrow-backed column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def decode(ids):
        c = codec(vocabulary)
        return ids.map(lambda x: None if x is None else c.decode(chain(x)))

    return decode(F.col(column))
