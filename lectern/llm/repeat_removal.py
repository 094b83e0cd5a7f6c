"""Removal of byte strings that repeat anywhere in the corpus.

Every byte inside a ``LENGTH``-byte string that also starts elsewhere goes; strings are judged on the
input and never cross documents. The result is exact (up to collisions of 64-bit hashes that must
agree with another one as well). Documents go by 128-bit hashes of id and text.

Each window of ``LENGTH`` bytes is owned by the least-hashed gram of ``GRAM`` bytes inside it, so equal
windows have equal owners at equal distance. Neighbouring windows with one owner form a stretch, about
85 bytes apart on average. Only stretches whose gram occurs twice can hold a repeat. A stretch that
occurs twice as a whole is a repeat as a whole, one row for up to 169 windows; what is left are
stretches at the ends of repeated passages, and their windows are compared one by one within a task, for
the stretches of one gram. Where a gram has more than ``MEET`` unlike stretches, a group's fixed limit
whatever the corpus, they are cut where the gram's place in a window is a multiple of 128, then of 64,
and so on down to single windows: pieces whose windows share no bytes with another's are done, pieces
that occur twice as a whole are repeats, one row each, and only groups that are still larger go on. A
passage's end so costs a few rows a level and occurrence, not one a window.

Counts by gram and by stretch combine on the map side; in joins on them the rows of very frequent
grams, stretches and windows are dealt over all partitions, so no task holds a passage's occurrences
together. Texts move twice, compressed.

Defined cases: a null or empty text keeps nothing and loses nothing; texts shorter than ``LENGTH`` bytes
stay whole; repeated rows repeat each other and lose all windows; an empty table gives no rows; extra
columns are ignored or, in ``deduplicated``, kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, hot_keys, map_rows, spread_join, text_of

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM + 1
#: Bytes of text that a task hashes at a time, and of stretches that it compares at a time; a dozen arrays of eight bytes each go with a byte.
SLAB = 1 << 18
#: Stretches of one gram that meet in one task; larger groups are cut into pieces, counted over all tasks.
MEET = 1_024
_U = np.uint64
_LOW = _U((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def hashes(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams and of all windows of a byte array, by doubling."""
    h, width, grams = b.astype(np.uint64) + _U(1), 1, None
    while 2 * width <= length:
        h = h[:-width] * _U(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> _U(29)))
        h ^= h >> _U(31)
        width *= 2
        if width == gram:
            grams = _mix(h)
    n, rest = len(b) - length + 1, length - width
    return grams, _mix(h[:n] * _U(3) + _mix(h[rest : rest + n]))


def stretches(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows - 1, gram hash, stretch hash) of documents laid end to end."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(b) < LENGTH:
        return none
    grams, windows = hashes(b)
    # Hash above, position below: the least value is the leftmost gram of least hash.
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(windows)
    owner = (np.minimum(low[:n], low[REACH - width : REACH - width + n]) & _LOW).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(n), "right")
    inside = np.arange(n) + LENGTH <= ends[np.minimum(doc, len(ends) - 1)]
    starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[starts[1:] - 1, n - 1]
    starts, last = starts[inside[starts]], last[inside[starts]]
    if not len(starts):
        return none
    g = grams[owner[starts]]
    whole = _mix(windows[starts] * _U(5) + _mix(windows[last] + (last - starts).astype(np.uint64)))
    first = np.r_[0, ends[:-1]][doc[starts]]
    return doc[starts], starts - first, last - starts, g, whole


def _slabs(batch: pa.RecordBatch, column: str, slab: int = SLAB) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``slab`` bytes, with their bytes laid end to end and the ends of each."""
    sizes = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    data = np.frombuffer(sizes.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slab, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


_ROW = pa.schema([(c, pa.int64()) for c in ("g", "c", "dk", "dl", "loc")])


def anchors(docs: DataFrame) -> DataFrame:
    """(g, c, dk, dl, loc) of every stretch; ``loc`` is first window * 256 + windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, ends in _slabs(batch, "text"):
                doc, first, more, g, c = stretches(b, ends)
                if len(doc):
                    keys = [part.column(k).to_numpy()[doc] for k in ("dk", "dl")]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), c.view(np.int64), *keys, first << 8 | more)], schema=_ROW)

    return docs.select("dk", "dl", "text").mapInArrow(run, "g long, c long, dk long, dl long, loc long")


def _packed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts compressed for their way through a shuffle."""
    types = dict(docs.dtypes)
    schema = ", ".join(["dk long, dl long", *(f"`{c}` {types[c]}" for c in keep), "z binary"])
    return map_rows(docs.select("dk", "dl", *keep, "text"), lambda: lambda *r: (*r[:-1], zlib.compress(r[-1].encode(), 1)), schema)


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of each stretch in ``rows(dk, dl, z, at array<struct<g, k, n, loc>>)``."""

    def make():
        def row(dk, dl, z, at):
            b = zlib.decompress(z)
            return [(x["g"], x["k"], x["n"], dk, dl, x["loc"], b[(s := x["loc"] >> 8) : s + (x["loc"] & 255) + LENGTH]) for x in at]

        return row

    return map_rows(rows.select("dk", "dl", "z", "at"), make, "g long, k long, n long, dk long, dl long, loc long, s binary", flat=True)


def _windows(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window within the row, hash) of all windows of strings laid end to end."""
    w = hashes(s)[1] if len(s) >= LENGTH else np.zeros(0, np.uint64)
    row = np.searchsorted(ends, np.arange(len(w)), "right")
    inside = np.arange(len(w)) + LENGTH <= ends[np.minimum(row, len(ends) - 1)]
    first = np.r_[0, ends[:-1]]
    at = np.flatnonzero(inside)
    return row[at], at - first[row[at]], w[at]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g: windows of single stretches that another stretch of their gram holds."""
    schema = pa.schema([(c, pa.int64()) for c in ("dk", "dl", "first", "last")])

    def met(table: pa.Table) -> pa.RecordBatch:
        rows = table.combine_chunks().to_batches()[0]
        _, s, ends = next(_slabs(rows, "s", 1 << 62))
        row, at, w = _windows(s, ends)
        g = rows.column("g").to_numpy().view(np.uint64)
        key = _mix(w ^ _mix(g[row]))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        hit = (n[inverse] > 1) & (rows.column("n").to_numpy()[row] == 1)
        row, at = row[hit], at[hit]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
        end = np.r_[new[1:] - 1, len(row) - 1] if len(row) else new
        loc = rows.column("loc").to_numpy() >> 8
        return pa.RecordBatch.from_arrays([*(pa.array(rows.column(k).to_numpy()[row[new]]) for k in ("dk", "dl")), pa.array(loc[row[new]] + at[new]), pa.array(loc[row[new]] + at[end])], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        g = batch.column("g").to_numpy()
        edges = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        for a, b in zip(edges, edges[1:]):
            if held and size > SLAB and held[-1].column("g")[-1].as_py() != g[a]:
                yield met(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(b - a) * (LENGTH + REACH)
    if held:
        yield met(pa.Table.from_batches(held))


_PIECE = pa.schema([*((c, pa.int64()) for c in ("g", "c", "n", "dk", "dl", "loc")), ("s", pa.binary())])


def _pieces(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches cut where their gram's place in a window is a multiple of ``size``.

    ``g`` becomes a hash of the bytes that all windows of such a block hold, equal for all pieces that
    could share a window; ``c`` a hash of the piece.
    """
    digest = lambda b, m: int.from_bytes(hashlib.blake2b(b, digest_size=8, salt=bytes([m])).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, ends in _slabs(batch, "s"):
                starts, out = np.r_[0, ends[:-1]], []
                grams = hashes(b)[0] & ~_LOW
                places = np.argmin(grams[starts[:, None] + np.arange(REACH)], axis=1).tolist()
                for place, n, dk, dl, loc, s in zip(places, *(part.column(c).to_pylist() for c in ("n", "dk", "dl", "loc", "s"))):
                    first, more = loc >> 8, loc & 255
                    for m in range((place - more) // size, place // size + 1):
                        low, high = m * size, min(m * size + size, REACH) - 1
                        i, j = max(0, place - high), min(more, place - low)
                        piece = s[i : j + LENGTH]
                        out.append((digest(s[place - low : place - high + LENGTH], m), digest(piece, m), n, dk, dl, first + i << 8 | j - i, piece))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    return run


def _shared(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces (n = 1) that occur again as a whole, and one copy of each piece whose ``g`` others have, with their number ``k``."""
    kinds = pieces.groupBy("c", "g").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("dk", "dl", "loc", "s")).alias("at"))
    kinds = checkpointed(kinds.select("g", "c", "n", "rows", "at.*"))
    often = kinds.filter("rows > 1").select("c", "g", "rows")
    whole = spread_join(pieces.filter("n = 1").drop("s"), often.select("c", "g"), ["c", "g"], hot_keys(often, "c", "rows"))
    mixed = checkpointed(kinds.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("g", "k"))
    return whole, checkpointed(spread_join(kinds.drop("c", "rows"), mixed, "g", hot_keys(mixed, "g", "k")))


def _run(rows: DataFrame) -> DataFrame:
    first = F.shiftright("loc", 8)
    return rows.select("dk", "dl", first.alias("first"), (first + F.col("loc").bitwiseAND(F.lit(255))).alias("last"))


def repeats(docs: DataFrame, meet: int = MEET) -> DataFrame:
    """(dk, dl, first, last): runs of repeated windows of the documents ``docs(dk, dl, text)``, in bytes."""
    spark = docs.sparkSession
    found = anchors(docs)
    twice = checkpointed(found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"))
    again = checkpointed(spread_join(found, twice.select("g"), "g", hot_keys(twice, "g")))
    kinds = again.groupBy("c", "g").agg(F.count("*").alias("n"), F.min(F.struct("dk", "dl", "loc")).alias("at"))
    kinds = checkpointed(kinds.select("g", "c", "n", "at.dk", "at.dl", "at.loc"))
    often = kinds.filter("n > 1")
    whole = spread_join(again, often.select("c", "g"), ["c", "g"], hot_keys(often.select("c", "n"), "c"))
    # Grams with a stretch that occurs once beside others: one copy of each of their stretches is cut out.
    mixed = checkpointed(kinds.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("g", "k"))
    open_ = spread_join(kinds, mixed, "g", hot_keys(mixed, "g", "k"))
    open_ = open_.groupBy("dk", "dl").agg(F.collect_list(F.struct("g", "k", "n", "loc")).alias("at"))
    cut = checkpointed(_cut(_packed(docs).dropDuplicates(["dk", "dl"]).join(open_, ["dk", "dl"])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ("g", "n", "dk", "dl", "loc", "s")
    found, near, size = [_run(whole)], cut.filter(F.col("k") <= meet).select(*columns), 128
    while size and not (large := cut.filter(F.col("k") > meet)).isEmpty():
        pieces = checkpointed(large.select(*columns).mapInArrow(_pieces(size), "g long, c long, n long, dk long, dl long, loc long, s binary"))
        whole, cut = _shared(pieces)
        found.append(_run(whole))
        near = near.unionByName(cut.filter(F.col("k") <= meet).select(*columns))
        size //= 2
    near = near.repartition(parts, "g").sortWithinPartitions("g")
    found.append(near.mapInArrow(_compare, "dk long, dl long, first long, last long"))
    return reduce(DataFrame.unionByName, found)


def spans(runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans covered by runs of windows, merged."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def keep(b: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in cut:
        parts.append(b[at:s])
        at = e
    return b"".join([*parts, b[at:]])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    key = lambda seed: F.xxhash64(F.lit(seed), F.col(id_column), F.col("text"))
    return docs.withColumn("text", text_of(text_column)).withColumn("dk", key(0)).withColumn("dl", key(1))


def _with_runs(rows: DataFrame, keep_columns: tuple[str, ...]) -> DataFrame:
    runs = repeats(rows.select("dk", "dl", "text")).groupBy("dk", "dl").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return _packed(rows, keep_columns).join(runs, ["dk", "dl"], "left").select(*keep_columns, "z", "runs")


def removal_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = _keyed(docs.select("doc_id", "text"), "doc_id", "text")

    def make():
        def row(key, z, runs):
            b = zlib.decompress(z)
            cut = spans([(r["first"], r["last"]) for r in runs or ()])
            return key, len(b), sum(e - s for s, e in cut), len(cut), hashlib.sha256(keep(b, cut)).hexdigest()

        return row

    return map_rows(_with_runs(rows, ("doc_id",)), make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts cut; code points that lose some of their bytes go whole, and so do rows left empty by a cut."""
    others = tuple(c for c in docs.columns if c != "text")
    renamed = docs.select(*(F.col(c).alias(f"_{c}") for c in others), "text")
    names = tuple(f"_{c}" for c in others)
    types = dict(renamed.dtypes)
    rows = _keyed(renamed, "_doc_id", "text")

    def make():
        def row(*r):
            b = zlib.decompress(r[-2])
            cut = spans([(x["first"], x["last"]) for x in r[-1] or ()])
            left = keep(b, cut).decode("utf-8", "ignore")
            return ((*r[:-2], left),) if left.strip() or not cut else ()

        return row

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string"])
    return map_rows(_with_runs(rows, names), make, schema, flat=True).select(*(F.col("text" if c == "text" else f"_{c}").alias(c) for c in docs.columns))
