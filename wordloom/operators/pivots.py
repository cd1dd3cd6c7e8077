"""Exact similarity search that skips cells of vectors by their distance to pivots.

Vectors are taken by their direction.  A bounded number of them, drawn by a hash
of the token, are pivots; a vector's cell is its nearest pivot's, and a cell
knows the largest angle between its pivot and a member, its radius.  For a query
at angle ``a`` to the pivot no member is nearer than ``a - radius``, so a cell
whose bound is beyond the query's n-th best similarity so far is never read.

A query first reads the cells whose pivots are nearest until these hold n
members, which gives a first n-th best, and then all cells that the bound does
not rule out.  Queries and members meet by cell in blocks of bounded size; a
(query, member) pair is never a row.  Results are those of ``similar_tokens``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blas import single_thread_blas
from ..session import materialize
from .similarity import Side, matrix, topn_side

#: Slack in radians for angles near zero, where the cosine is least exact.
SLACK = 1e-6
NO_CELL = -1


@dataclass
class PivotIndex:
    """``members``: cell, shelf, part, token, embedding; ``cells``: cell, n, radius, parts, shelf; pivots' unit vectors by cell."""

    members: DataFrame
    cells: DataFrame
    pivots: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(_padded(m, pivots.shape[1])) @ pivots.T, -1.0, 1.0))


def _column(column) -> np.ndarray:
    """A column of vectors as rows."""
    lengths = np.diff(column.offsets.to_numpy()) if isinstance(column, pa.ListArray) else None
    if lengths is None or not len(lengths) or column.null_count or (lengths != lengths[0]).any() or column.flatten().null_count:
        return matrix(column.to_pylist())
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def _shelves(cells, part_rows: int):
    """The table of cells, with the shelf of each: neighbouring cells of at most ``part_rows`` members together, a larger one alone."""
    cells = cells.sort_values("cell").reset_index(drop=True)
    shelf, held, shelves = -1, part_rows, []
    for n in cells["n"]:
        if held + n > part_rows:
            shelf, held = shelf + 1, 0
        held += n
        shelves.append(shelf)
    return cells.assign(shelf=np.array(shelves, np.int32))


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def build_pivot_index(vectors: DataFrame, n_pivots: int = 256, part_rows: int = 20_000, seed: int = 42) -> PivotIndex:
    """Index ``(token, embedding)``; every vector gets a cell, those without direction the cell -1.

    The pivots, ``n_pivots`` rows at most, are all that the driver holds.  A cell
    of more than ``part_rows`` members is cut into parts by a hash of the token;
    smaller ones share a shelf, so that a query goes to a shelf once, not to each
    of its cells.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("token").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = (v.filter(F.exists("embedding", lambda x: x != 0)).withColumn("draw", F.xxhash64("token", "embedding", F.lit(seed)))
              .orderBy("draw", "token").limit(n_pivots).collect())
    # Shorter vectors are padded with zeros, as cosine defines it.
    width = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    pivots = np.unique(_unit(_padded(matrix([r["embedding"] for r in drawn]), width)), axis=0) if drawn else np.zeros((0, width))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        single_thread_blas()
        p = shared.value
        for b in batches:
            m = _padded(_column(b.column("embedding")), p.shape[1])
            cell, angle = np.full(len(m), NO_CELL, np.int32), np.zeros(len(m))
            has = (m != 0).any(axis=1)
            if has.any():
                a = _angles(m[has], p)
                cell[has], angle[has] = a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), b.column("token"), b.column("embedding")],
                                             ["cell", "angle", "token", "embedding"])

    placed = materialize(v.mapInArrow(assign, "cell int, angle double, token string, embedding array<double>"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    # A row for each pivot at most: small at any number of vectors.
    table = _shelves(cells.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")).toPandas(), part_rows)
    cells = spark.createDataFrame([tuple(r) for r in table[["cell", "n", "radius", "parts", "shelf"]].astype(object).to_numpy()],
                                  "cell int, n long, radius double, parts int, shelf int")
    members = materialize(placed.join(F.broadcast(cells.select("cell", "parts", "shelf")), "cell").select(
        "cell", "shelf", F.pmod(F.xxhash64("token"), F.col("parts")).cast("int").alias("part"), "token", "embedding"))
    return PivotIndex(members, cells, pivots)


#: Queries whose cells are chosen together.
PROBED = 512


def _probes(index: PivotIndex, n: int, known: bool):
    """Cells that a query reads: a row ``query, qid, qvec, shelf, cells`` for each shelf that has some.

    Without ``known`` n-th best similarities (column ``worst``) the nearest cells
    until they hold n members; with them all further ones that the bound leaves.
    """
    table = index.cells.orderBy("cell").toPandas()
    cell = table["cell"].to_numpy(np.int64)
    with_pivot = cell >= 0
    size, radius = table["n"].to_numpy(np.int64), table["radius"].to_numpy(np.float64)
    total, pivots = int(size.sum()), index.pivots     # an index of nothing has nothing to read
    shelf = table["shelf"].to_numpy(np.int64)

    def run(batches):
        single_thread_blas()
        for b in (batch.slice(at, PROBED) for batch in batches for at in range(0, batch.num_rows, PROBED)):
            if not total:
                continue
            m = _padded(_column(b.column("qvec")), pivots.shape[1])
            blank = ~(m != 0).any(axis=1)
            angle = np.zeros((len(m), len(cell)))
            angle[:, with_pivot] = _angles(m, pivots)[:, cell[with_pivot]]
            # Members without direction have no similarity and come last: read only if the others are too few.
            angle[:, ~with_pivot] = np.inf
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = before < n
            # A query without direction has no similarity to anything: only tokens decide, so it reads all cells.
            first[blank] = True
            if known:
                worst = np.array([np.nan if w is None else w for w in b.column("worst").to_pylist()], np.float64)
                full = np.array(b.column("found").to_pylist(), np.int64) >= min(n, total)
                limit = np.where(full & np.isfinite(worst), np.arccos(np.clip(worst, -1.0, 1.0)), np.inf)
                bound = np.take_along_axis(angle - radius, order, axis=1)
                first = ~first & (bound <= limit[:, None] + SLACK)
            q, k = np.nonzero(first)
            k = order[q, k]
            by = np.lexsort((k, shelf[k], q))
            q, k = q[by], k[by]
            if not len(q):
                continue
            starts = np.nonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(shelf[k]) != 0)]))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.array(cell[k].astype(np.int32)))
            # A query is repeated for its shelves: few rows at a time.
            for s in range(0, len(starts), PROBED):
                own = starts[s:s + PROBED]
                at = pa.array(q[own])
                yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("query", "qid", "qvec")]
                                                 + [pa.array(shelf[k[own]].astype(np.int32)), lists.slice(s, len(own))],
                                                 ["query", "qid", "qvec", "shelf", "cells"])

    return run


def _read(index: PivotIndex, probes: DataFrame, n: int, query_rows: int) -> DataFrame:
    """Top n of the probed cells of every shelf's part for every query: ``query, qid, token, similarity``."""
    # Queries of a shelf are cut into blocks; a member goes to each of them.
    asked = probes.groupBy("shelf").agg(F.count(F.lit(1)).alias("asked"))
    parts = index.cells.groupBy("shelf").agg(F.max("parts").alias("parts"))
    sides = parts.join(asked, "shelf").select("shelf", "parts", F.ceil(F.col("asked") / query_rows).cast("int").alias("blocks"))
    sides = F.broadcast(materialize(sides))   # a row for each pivot at most
    q = (probes.join(sides, "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .withColumn("block", F.pmod(F.xxhash64("query", "qid"), F.col("blocks")).cast("int"))
               .select("shelf", "part", "block", "query", "qid", "qvec", "cells"))
    v = (index.members.join(sides.drop("parts"), "shelf")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shelf", "part", "block", "cell", "token", "embedding"))
    keys = ["shelf", "part", "block"]

    def block(queries: pa.Table, members: pa.Table) -> pa.Table:
        single_thread_blas()
        if not queries.num_rows or not members.num_rows:
            return _FOUND.empty_table()
        tokens, cell = np.array(members.column("token").to_pylist(), dtype=object), members.column("cell").to_numpy()
        M, Q = (_column(t.column(c).combine_chunks()) for t, c in ((members, "embedding"), (queries, "qvec")))
        lists = queries.column("cells").combine_chunks()
        wanted, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        row, token, similarity = [], [], []
        for c in np.unique(cell).tolist():
            asking, own = by[wanted == c], np.nonzero(cell == c)[0]
            for r in range(0, len(asking), 4096):
                here, found, s = topn_side(Q[asking[r:r + 4096]], Side(tokens[own], M[own]), n)
                row.append(asking[r:r + 4096][here])
                token.append(found)
                similarity.append(s)
        row, token, similarity = (np.concatenate(x) if x else np.zeros(0, t) for x, t in
                                  ((row, np.int64), (token, object), (similarity, np.float64)))
        # Of its cells' best each query keeps the best n.
        order = np.lexsort((np.unique(token, return_inverse=True)[1], -similarity, row))
        row, token, similarity = row[order], token[order], similarity[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < n
        row, token, similarity = row[best], token[best], similarity[best]
        at = pa.array(row)
        return pa.table([queries.column("query").take(at), queries.column("qid").take(at), pa.array(token, pa.string()),
                         pa.array(similarity, pa.float64(), from_pandas=True)], schema=_FOUND)

    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(block, "query string, qid long, token string, similarity double")


_FOUND = pa.schema([("query", pa.string()), ("qid", pa.int64()), ("token", pa.string()), ("similarity", pa.float64())])


def search_pivot_index(index: PivotIndex, queries: DataFrame, top_n: int = 10, query_col: str = "query",
                       query_vec: str = "embedding", query_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """E2 through the index: ``(query, token, similarity, rank)``, and ``(cells_read, share)`` of the search.

    ``share`` is the number of members that queries read, by that of a full scan.
    """
    q = materialize(queries.select(F.col(query_col).cast("string").alias("query"), F.col(query_vec).cast("array<double>").alias("qvec"))
                           .dropDuplicates().withColumn("qid", F.xxhash64("qvec")))
    schema = "query string, qid long, qvec array<double>, shelf int, cells array<int>"
    first = materialize(q.mapInArrow(_probes(index, top_n, False), schema))
    found = materialize(_read(index, first, top_n, query_rows))
    best = Window.partitionBy("query", "qid").orderBy(F.col("similarity").desc_nulls_last(), "token")
    ranked = found.withColumn("place", F.row_number().over(best))
    worst = ranked.filter(F.col("place") <= top_n).groupBy("query", "qid").agg(F.min("similarity").alias("worst"), F.count("similarity").alias("found"))
    more = q.join(worst, ["query", "qid"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    second = materialize(more.mapInArrow(_probes(index, top_n, True), schema))
    every = found.unionByName(_read(index, second, top_n, query_rows))
    out = (every.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top_n)
                .select("query", "token", "similarity", "rank"))
    read = first.unionByName(second).select(F.explode("cells").alias("cell")).join(F.broadcast(index.cells), "cell")
    whole = q.select(F.count(F.lit(1))).scalar() * index.cells.select(F.sum("n")).scalar()
    share = read.agg(F.count(F.lit(1)).alias("cells_read"), (F.sum("n") / whole).alias("share"))
    return out, share
