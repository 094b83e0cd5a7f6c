"""Text scalars as Catalyst expressions.

Patterns carry ``(?U)`` so that word, space and boundary classes are Unicode classes. Positions are
code points, as Spark counts them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label, cleaning and word patterns of the transcript format.
SPEAKER_LINE = r"^\s*([A-Z][A-Z0-9 .'-]{0,40})[:\-]\s*(.*)$"
STAGE_DIRECTION = r"(?U)\s*[\[(][^\]\)]*[\])]"
TIMESTAMP = r"(?U)\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
TITLE_PREFIXES = ("MR", "MRS", "MS", "DR", "PROF", "SEN", "REP", "PRES", "GOV", "GOVERNOR", "SPEAKER", "CHAIR")
LEADING_TITLES = ("CANDIDATE", "SPEAKER", "PARTICIPANT", "DEBATER", "SENATOR", "GOVERNOR", "CONGRESSMAN", "CONGRESSWOMAN", "MINISTER")
UNKNOWN = "UNKNOWN"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def strip_stage_directions(c: Column) -> Column:
    return F.regexp_replace(c, STAGE_DIRECTION, " ")


def strip_timestamps(c: Column) -> Column:
    return F.regexp_replace(c, TIMESTAMP, " ")


def canonical(c: Column) -> Column:
    """Lower case, single spaces, no punctuation."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def canonical_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def short_hash(c: Column) -> Column:
    return F.substring(canonical_hash(c), 1, 24)


def entity_key(name: Column) -> Column:
    return short_hash(name)


def claim_key(text: Column, start: Column, end: Column) -> Column:
    whole = F.concat(canonical_hash(text), F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))
    return F.concat(F.lit("claim_"), F.substring(F.sha2(whole, 256), 1, 24))


def answer_key(schema: int, model: str, text: Column) -> Column:
    """Cache key of a classifier's answer."""
    return F.sha2(F.concat(F.lit(f"v{schema}:{model}:"), canonical(text)), 256)


def squeezed(c: Column) -> Column:
    """Lower case with single spaces: the identity of a generated claim."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def shortened(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    part = lambda unit, size: (F.floor(ms / unit) % size).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1_000, 60), (ms % 1_000).cast("long"))


def is_video_url(url: Column) -> Column:
    # The address forms that count as a video link.
    forms = ("youtube.com/watch", "youtu.be/", "youtube.com/v/", "youtube.com/embed/")
    found = F.lit(False)
    for f in forms:
        found = found | F.contains(url, F.lit(f))
    return found


def normalize_speaker(raw: Column) -> Column:
    """Short comparable speaker names: titles go, a longer name leaves its last part."""
    label = F.upper(strip(raw))
    parts = F.filter(F.split(label, r"(?U)\s+"), lambda p: p != "")
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\.+$", "")), lambda p: ~p.isin(*TITLE_PREFIXES))
    names = F.when(F.size(bare) > 0, bare).otherwise(parts)
    n, first, last = F.size(names), F.element_at(names, 1), F.element_at(names, -1)
    return (
        F.when(label == "", F.lit(UNKNOWN))
        .when((n >= 2) & first.isin(*LEADING_TITLES), last)
        .when(n > 2, last)
        .when((n == 2) & (first == last), first)
        .otherwise(F.array_join(names, " "))
    )


#: Pieces whose lengths are summed directly; longer runs go by sums of such chunks.
CHUNK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body looks at it."""
    return F.transform(F.array(value), body)[0]


def with_starts(pieces: Column) -> Column:
    """``array<struct<piece, start>>``: where each piece starts if all are laid end to end, in linear time."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def bases(sizes: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / CHUNK).cast("int")), lambda c: add(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))
        return F.aggregate(chunks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def placed(ps: Column, sizes: Column, base: Column) -> Column:
        start = lambda i: F.get(base, F.floor(i / CHUNK).cast("int")) + add(F.slice(sizes, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))
        return F.transform(ps, lambda p, i: F.struct(p.alias("piece"), start(i).alias("start")))

    return let(pieces, lambda ps: let(F.transform(ps, lambda p: F.length(p)), lambda sizes: let(bases(sizes), lambda base: placed(ps, sizes, base))))
