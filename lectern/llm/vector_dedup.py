"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid of cells. Every distinct vector
lies in its home cell and queries the cells nearest to it in both halves: a multi-sequence traversal
takes cells in order of their distance from the vector until those beyond can hold next to no partner.
The distance of a cell is a bound: how far the vector must move before the cell's centroids are the
nearest. A pair at the threshold is ``sqrt(2 - 2 * threshold)`` apart; a move of that length in a
random direction of D dimensions goes ``length / sqrt(D)`` towards a given bound, and ``REACH`` such
deviations are covered (0.9999 of such moves for 4). Every pair met in a cell is verified in double
precision, so no link is false; the tests measure recall against brute force. A pair that only one of
its vectors meets counts for both.

Equal vectors are folded into one with a count before anything is compared. A cell's vectors and
queries are dealt into blocks, and only block pairs travel together, so a group of any size is split
and its links are counted without ever being listed. The grid grows with the largest label, so that a
cell holds about ``CELL`` vectors at every size: a half has the square root of vectors / ``CELL``
centroids. The codebooks are trained on ``SAMPLE`` vectors, or ``PER_CENTROID`` for each centroid if
that is more, those of least hash (225,000 for 50 billion vectors); every vector is indexed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without label or id, link with nothing and are components of their own; vectors of unlike length don't
link; repeated rows count as vectors of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, hot_keys, spread_join
from lectern.llm.components import components

THRESHOLD, SAMPLE, REACH = 0.98, 20_000, 4.0
#: Vectors that a cell should hold, about, and training vectors of a centroid, at least.
CELL, PER_CENTROID = 256, 16
#: Least and most vectors of a block; between them a block is a share of the mean partition.
MIN_BLOCK, MAX_BLOCK = 256, 4_096


def unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of ``x`` by Lloyd's rounds, from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([(part @ c.T * -2 + (c * c).sum(1)).argmin(1) for part in np.array_split(x, -(-len(x) // 4096))])
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row and centroid: how far the row must move before that centroid is its nearest."""
    size = (c * c).sum(1)
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + size
    home = d.argmin(1)
    apart = np.sqrt(np.maximum(size[home][:, None] - 2 * c[home] @ c.T + size, 1e-30))
    out = np.maximum(d - d[np.arange(len(x)), home][:, None], 0) / (2 * apart)
    out[np.arange(len(x)), home] = 0
    return out


def traverse(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells of the grid by growing distance, the home cell first, up to ``reach``."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap, seen = [(0.0, 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > reach * reach:
            return
        yield int(a[i]), int(b[j])
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(a) and j < len(b) and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(heap, (first[a[i]] ** 2 + second[b[j]] ** 2, i, j))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def index(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], width: int, reach: float) -> DataFrame:
    """Unit vectors with their home cell and the cells they query."""
    half, k = width // 2, len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                x = unit(_matrix(b.column("embedding"), width))
                lows = [bounds(x[:, :half], books[0]), bounds(x[:, half:], books[1])]
                cells = [[i * k + j for i, j in traverse(p, q, reach)] for p, q in zip(*lows)]
                cols = [b.column("cls"), b.column("grp"), b.column("n"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c[0] for c in cells], pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["cls", "grp", "n", "v", "home", "cells"])

    return classes.select("cls", "grp", "n", "embedding").mapInArrow(assign, "cls string, grp string, n long, v binary, home int, cells array<int>")


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, cell, mb, qb): compare one block of members with one of queries at a time."""

    def groups():
        rows, at = [], None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "mb", "qb", "query", "cls", "n", "v", "home", "cells"))):
                if r[:4] != at:
                    if rows:
                        yield rows
                    rows, at = [], r[:4]
                rows.append(r[4:])
        if rows:
            yield rows

    schema = pa.schema([("cls", pa.string()), ("n", pa.int64()), ("root", pa.string())])
    for rows in groups():
        members, queries = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        if not members or not queries:
            continue
        m, q = (np.frombuffer(b"".join(r[3] for r in x)).reshape(len(x), -1) for x in (members, queries))
        linked = q @ m.T >= threshold
        if not linked.any():
            continue
        n = linked @ np.array([r[2] for r in members])
        # A member that doesn't query the cell of its partner won't meet it there: the pair counts for it here.
        homes, home = np.unique([r[4] for r in queries], return_inverse=True)
        meets = np.array([np.isin(homes, r[5]) for r in members])
        more = (linked & ~meets[:, home].T).T @ np.array([r[2] for r in queries])
        label = np.arange(len(members))
        while True:
            of_query = np.where(linked, label, len(members)).min(1)
            new = np.minimum(label, np.where(linked, of_query[:, None], len(members)).min(0))
            if (new == label).all():
                break
            label = new
        out = [(r[1], int(k), members[c][1] if c < len(members) else r[1]) for r, k, c in zip(queries, n, of_query) if k]
        out += [(r[1], int(k), members[c][1]) for i, (r, c, k) in enumerate(zip(members, label, more)) if i != c or k]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def links(indexed: DataFrame, threshold: float) -> DataFrame:
    """(cls, n, root): vectors linked to ``cls`` within a block pair, and an edge of its spanning stars."""
    spark = indexed.sparkSession
    query = indexed.select("grp", F.explode("cells").alias("cell"), F.lit(True).alias("query"), "cls", "n", "v", "home", F.lit(None).cast("array<int>").alias("cells"))
    member = indexed.select("grp", F.col("home").alias("cell"), F.lit(False).alias("query"), "cls", "n", "v", "home", "cells")
    sides = [x.select("grp", "cell").groupBy("grp", "cell").agg(F.count("*").alias(n)) for x, n in ((member, "members"), (query, "queries"))]
    sizes = checkpointed(sides[0].join(sides[1], ["grp", "cell"]))
    rows = sizes.agg(F.sum(F.col("members") + F.col("queries"))).first()[0] or 0
    block = int(min(MAX_BLOCK, max(MIN_BLOCK, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    place = F.concat_ws("|", "grp", "cell").alias("place")
    hot = hot_keys(sizes.select(place, (F.col("members") + F.col("queries")).alias("n")), "place")
    sizes = sizes.select("grp", "cell", F.ceil(F.col("members") / block).alias("mbs"), F.ceil(F.col("queries") / block).alias("qbs"))
    own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    sized = lambda rows: spread_join(rows.withColumn("place", place), sizes.select(place, "mbs", "qbs"), "place", hot).drop("place")
    query = sized(query).withColumn("qb", own("qbs")).withColumn("mb", every("mbs"))
    member = sized(member).withColumn("mb", own("mbs")).withColumn("qb", every("qbs"))
    cut = query.unionByName(member).select("grp", "cell", "mb", "qb", "query", "cls", "n", "v", "home", "cells")
    cut = cut.repartition("grp", "cell", "mb", "qb").sortWithinPartitions("grp", "cell", "mb", "qb")
    return cut.mapInArrow(lambda b: _blocks(b, threshold), "cls string, n long, root string")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, reach: float = REACH, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The contract's rows: ``vec_id, n_links, component_id, kept``."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("good", F.coalesce(usable & finite, F.lit(False)))
    group = F.concat_ws("/", F.col("label").cast("string"), F.size(e).cast("string"))
    key = F.concat_ws("-", F.hex(F.xxhash64("grp", "embedding")), F.hex(F.xxhash64(F.lit(1), "grp", "embedding")))
    good = rows.filter("good").withColumn("grp", group).withColumn("cls", key)
    # Equal vectors meet by their two hashes; the vector itself is taken from any of them.
    classes = checkpointed(good.groupBy("cls").agg(F.first("grp").alias("grp"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n")))
    width, most = classes.groupBy("grp").agg(F.max(F.size("embedding")).alias("w"), F.count("*").alias("c")).agg(F.max("w"), F.max("c")).first()
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not width:
        return alone
    width = max(width, 2)
    k = int(max(1, round((most / CELL) ** 0.5)))
    picked = [r[0] for r in classes.orderBy(F.xxhash64(F.lit("sample"), "cls"), "cls").limit(max(sample, PER_CENTROID * k)).select("embedding").collect()]
    fit = np.zeros((len(picked), width))
    for i, v in enumerate(picked):
        fit[i, : len(v)] = v
    fit = unit(fit)
    books = codebook(fit[:, : width // 2], min(k, len(fit))), codebook(fit[:, width // 2 :], min(k, len(fit)))
    length = max(0.0, 2 - 2 * threshold) ** 0.5
    indexed = checkpointed(index(classes, books, width, length * min(1.0, reach / width**0.5)))
    found = checkpointed(links(indexed, threshold))
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")).distinct())
    named = classes.select("cls", "least", "n").join(roots, classes["cls"] == roots["node"], "left")
    placed = checkpointed(named.select("cls", "least", F.coalesce("root", "cls").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    info = spread_join(placed, least.drop("n"), "root", hot_keys(least, "root")).join(counts, "cls", "left")
    info = info.select("cls", "component_id", (F.coalesce("n", F.lit(1)) - 1).alias("n_links"))
    joined = spread_join(good.select("vec_id", "cls"), info, "cls", hot_keys(classes, "cls"))
    return joined.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
