"""Packing of tokenized documents into sequences of a fixed window.

A document longer than the window fills whole sequences first; what is left of
it, its rest, is shorter than the window.  The rests' lengths make a histogram
(bounded by the window), and how they share sequences is decided on it alone:

1. combinations of two to four lengths that fill the window are enumerated;
2. non-negative least squares on the histogram gives their repeat counts;
3. the counts are rounded down and bounded by the rests that are left, then the
   combinations are taken once more, greedily, as often as the rests allow;
4. the residual rests stand end to end, from long to short, and are cut at the
   window; the tail, shorter than a window, is cut into powers of two.

No sequence needs padding: all but the tail's are full, and those are powers of
two.  Only residual rests are cut.  A rest is known by its length and its rank
among the rests of that length, so that the plan, which is bounded by the
window, is all that is broadcast.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices
from .pieces import text_ids

#: Documents' ids: ``part, row`` tell the rows of a table apart, whatever their doc_id.
TOKENS = "part int, row long, doc_id long, n long, width int, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(docs: DataFrame, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, row, doc_id, n, width, ids``: ids of every whole text with ``end_id`` appended.

    ``ids`` are little-endian numbers of ``width`` bytes.  A null text is empty
    and has the end id alone; added tokens keep their own ids.
    """
    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in slices(batches, 4096):
            texts = [t.encode() if t else b"" for t in b.column(1).to_pylist()]
            for first, ids, at in text_ids(path, texts):
                end = np.array([end_id], ids.dtype).tobytes()
                raw = [ids[i:j].tobytes() + end for i, j in zip(at[:-1], at[1:], strict=True)]
                k = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(row, row + k)), b.column(0).slice(first, k),
                     pa.array(np.diff(at) + 1), pa.array(np.full(k, ids.dtype.itemsize, np.int32)), pa.array(raw, pa.binary())],
                    ["part", "row", "doc_id", "n", "width", "ids"])
                row += k

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, TOKENS)


def combinations(histogram: np.ndarray, window: int, partners: int = 12) -> np.ndarray:
    """Rows of four lengths, ascending and filled up with zeros at the left, that sum to the window.

    All pairs of lengths that occur; for every length that occurs the triples
    and quadruples whose other lengths, but the last one, are ``partners``
    quantiles of the histogram.
    """
    have = np.flatnonzero(histogram)
    if not len(have):
        return np.zeros((0, 4), np.int64)
    mass = np.cumsum(histogram[have])
    marks = have[np.unique(np.searchsorted(mass, (np.arange(partners) + 0.5) / partners * mass[-1]))]
    zero = np.zeros(1, np.int64)
    found = []
    for b, c in ((zero, zero), (marks, zero), (marks, marks)):
        a, x, y = (g.ravel() for g in np.meshgrid(have, b, c, indexing="ij"))
        found.append(np.stack([y, x, a, window - a - x - y], axis=1))
    rows = np.concatenate(found)
    rest = rows[:, 3]
    rows = rows[(rest > 0) & (histogram[np.clip(rest, 0, window - 1)] > 0)]
    return np.unique(np.sort(rows, axis=1), axis=0)


def repeat_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Counts x >= 0 of the combinations, minimising ``|A x - histogram|`` by accelerated projected gradients.

    Column j of A holds how often combination j takes each length; only its
    four entries are kept.
    """
    size = len(histogram)
    used = rows > 0
    h = histogram.astype(np.float64)

    def times(x):
        return np.bincount(rows.ravel(), np.repeat(x, 4), size) * (np.arange(size) > 0)

    def back(y):
        return (y[rows] * used).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):                       # the largest eigenvalue of A'A bounds the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1.0 / (1.05 * top + 1e-12)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - h))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


#: Times that combinations are enumerated anew on what rounding has left.
ROUNDS = 6


def plan(histogram: np.ndarray, window: int) -> dict:
    """Where the rests of every length go, by their rank: see :func:`_places` for the arrays.

    ``histogram[k]`` is the number of rests of length k (0 < k < window).
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    alloc, sequence = [], 0
    next_rank = np.zeros(window, np.int64)

    def take(row: list[int], most: float) -> None:
        """Fill sequences with one combination, up to ``most`` times or as the rests allow."""
        nonlocal sequence
        lengths = [n for n in row if n]
        k = int(min(most, min(left[n] // lengths.count(n) for n in lengths)))
        if k <= 0:
            return
        at = 0
        for n in lengths:
            alloc.append((n, int(next_rank[n]), sequence, at))
            next_rank[n] += k
            left[n] -= k
            at += n
        sequence += k

    rows = combinations(left, window)
    x = repeat_counts(rows, left) if len(rows) else np.zeros(0)
    order = np.argsort(-x, kind="stable")
    for row, most in zip(rows[order].tolist(), x[order].tolist(), strict=True):
        if most < 1:
            break
        take(row, most)
    for _ in range(ROUNDS):                   # what rounding left, as often as possible
        before = sequence
        for row in combinations(left, window).tolist():
            take(row, np.inf)
        if sequence == before:
            break
    stream = 0
    residual = []
    for length in range(window - 1, 0, -1):
        if left[length]:
            residual.append((length, next_rank[length], stream))
            stream += length * int(left[length])
    table = sorted([(n, r, s, o, -1) for n, r, s, o in alloc] + [(n, r, -1, -1, p) for n, r, p in residual])
    names = ("length", "rank", "sequence", "offset", "stream")
    out = {k: np.array([row[i] for row in table], np.int64) for i, k in enumerate(names)}
    full, tail = divmod(stream, window)
    edges = [full * window]
    for bit in range(window.bit_length(), -1, -1):
        if tail >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    first = np.zeros(window + 1, np.int64)
    first[1:] = np.cumsum(histogram)
    return out | {"first": first, "sequences": sequence, "full": full, "edges": np.array(edges, np.int64)}


def _places(p: dict, window: int, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the rest, length, sequence, offset) of a rest's pieces; sequences from 0."""
    k = int(np.searchsorted(p["key"], (length << 40) + rank, "right")) - 1
    if p["stream"][k] < 0:
        return [(0, length, int(p["sequence"][k] + rank - p["rank"][k]), int(p["offset"][k]))]
    at = int(p["stream"][k] + (rank - p["rank"][k]) * length)
    out, end, start = [], at + length, 0
    while at < end:
        if at < p["edges"][0]:
            no, cut = at // window, (at // window + 1) * window
            offset = at % window
        else:
            i = int(np.searchsorted(p["edges"], at, "right"))
            no, cut, offset = p["full"] + i - 1, int(p["edges"][i]), at - int(p["edges"][i - 1])
        k = min(cut, end) - at
        out.append((start, k, p["sequences"] + no, offset))
        at, start = at + k, start + k
    return out


def _number(window: int, batches):
    """Places of a task's rows in its own order: ``place`` among them, ``fulls`` whole sequences before each."""
    part, place, fulls = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        whole = b.column("n").to_numpy() // window
        k = b.num_rows
        before = fulls + np.cumsum(whole) - whole
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(place, place + k)), pa.array(before)],
            [*b.schema.names, "task", "place", "fulls"])
        place, fulls = place + k, fulls + int(whole.sum())


def pack(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """Pieces of all rows of a table of :func:`tokenize`, with their sequences and their ids.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``
    (little-endian u32); every id of every row lies in exactly one piece.  A
    sequence's pieces follow each other without gaps from offset 0.  Rows that
    repeat a doc_id are documents of their own.  ``tokens`` must give the same
    rows whenever it is read (a stored table).  ``window`` is a power of two.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = tokens.sparkSession
    keys = tokens.select("part", "row", "doc_id", "n")
    ordered = [F.pmod("n", F.lit(window)).alias("rest"), "doc_id", "part", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        keys.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
            .mapInArrow(partial(_number, window), "part int, row long, doc_id long, n long, task int, place long, fulls long"))
    # One row per task, and one per length of a rest: both stay small at any size of the input.
    sums = (numbered.groupBy("task").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("fulls"))
                    .toPandas().sort_values("task"))
    rests = numbered.groupBy(F.pmod("n", F.lit(window)).alias("rest")).count().toPandas()
    histogram = np.zeros(window, np.int64)
    histogram[rests["rest"].to_numpy(np.int64)] = rests["count"].to_numpy(np.int64)
    before = {int(t): (int(r), int(f)) for t, r, f in zip(
        sums["task"], sums["rows"].cumsum() - sums["rows"], sums["fulls"].cumsum() - sums["fulls"], strict=True)}
    whole = int(sums["fulls"].sum()) if len(sums) else 0
    p = plan(histogram, window)
    p["key"] = (p["length"] << 40) + p["rank"]
    shared = spark.sparkContext.broadcast((p, before))

    def cut(batches):
        p, before = shared.value
        for b in slices(batches, 512):
            r = b.to_pydict()
            rows = []
            for i, n in enumerate(r["n"]):
                ids = np.frombuffer(r["ids"][i], f"<u{r['width'][i]}").astype("<u4")
                first_place, first_full = before[r["task"][i]]
                chunks, rest = divmod(n, window)
                places = [(k * window, window, first_full + r["fulls"][i] + k, 0) for k in range(chunks)]
                if rest:
                    rank = first_place + r["place"][i] - int(p["first"][rest])
                    places += [(chunks * window + s, k, whole + q, o) for s, k, q, o in _places(p, window, rest, rank)]
                rows += [(r["doc_id"][i], s, k, n, q, o, ids[s:s + k].tobytes()) for s, k, q, o in places]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    joined = tokens.select("part", "row", "width", "ids").join(numbered, ["part", "row"])
    return joined.select("doc_id", "n", "width", "ids", "task", "place", "fulls").mapInArrow(cut, PIECES)


_TYPES = [*[pa.int64()] * 6, pa.binary()]
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
