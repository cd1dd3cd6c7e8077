"""Training-sample generation.

Windows are built from one array of token ids per document (the document is
already one row upstream), so no per-token sort or self-join is needed: each
task takes the ids of many samples at once (NumPy in Arrow batches).  Randomness is a seeded hash of (seed, doc_id, pos),
independent of partitioning and task retries.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blas import single_thread_blas
from ..functions.vector import keep_probability, seeded_uniform
from ..session import materialize
from .arrays import chunks, encode_arrays, least_count, sampling_flags
from .joins import salted_lookup


def encode_with_stats(occ: DataFrame, vocab: DataFrame, hot_share: float = 1e-4,
                      salt_buckets: int = 32, stats: bool = True) -> DataFrame:
    """J1 keeping the statistics sampling needs: ``doc_id, pos, token, token_id, occurrences, frequency``.

    Documents as arrays give ``doc_id, pos, ids[, occurrences, frequency]`` (see :mod:`.arrays`),
    without ``stats`` the ids only.
    """
    if "tokens" in occ.columns:
        return encode_arrays(occ, vocab, stats=stats)
    dim = vocab.select("token", "token_id", "occurrences", "frequency")
    return salted_lookup(occ, dim, "token", weight_col="occurrences", how="inner",
                         hot_share=hot_share, salt_buckets=salt_buckets, salt_cols=["doc_id", "pos"])


def with_sampling_flag(encoded: DataFrame, min_occurrences: int = 2, subsample: float = 1e-3,
                       seed: int = 42, epoch: int = 0) -> DataFrame:
    """P7 + W7: ``keep`` = occurrences >= min and uniform(seed, epoch, doc, pos) < keep probability."""
    if "ids" in encoded.columns:
        return sampling_flags(encoded, min_occurrences, subsample, seed, epoch)
    u = seeded_uniform(seed, F.lit(epoch), "doc_id", "pos")
    return encoded.withColumn(
        "keep", (F.col("occurrences") >= F.lit(min_occurrences)) &
                (u < keep_probability("frequency", subsample)))


def id_arrays(encoded: DataFrame, with_keep: bool = False) -> DataFrame:
    """Per document ``(doc_id, ids ARRAY<LONG>[, keep ARRAY<BOOLEAN>])`` in position order."""
    if "ids" in encoded.columns:
        return encoded.select("doc_id", "ids", *(["keep"] if with_keep else []))
    fields = ["pos", "token_id"] + (["keep"] if with_keep else [])
    # Few, heavy rows follow (windows, NumPy features): keep them spread over
    # the configured partitions instead of letting AQE coalesce them into a
    # handful of tasks.  The groupBy reuses this partitioning (one shuffle).
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (encoded.repartition(n, "doc_id").groupBy("doc_id")
                .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__s")))
    cols = ["doc_id", F.transform("__s", lambda x: x["token_id"]).alias("ids")]
    if with_keep:
        cols.append(F.transform("__s", lambda x: x["keep"]).alias("keep"))
    return s.select(*cols)


#: Positions that a chunk of a document has of its own.
CHUNK = 4096


def id_chunks(encoded: DataFrame, before: int, after: int = 0, with_keep: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, chunk, first, ids[, keep])``: documents in chunks that overlap, for windows of bounded reach.

    Chunk k owns the positions from ``k * chunk`` up to the next chunk's; ``ids``
    also holds up to ``before`` ids ahead of them and ``after`` behind, ``first``
    is the position of ``ids[0]``.  An id is copied only near a chunk's edge, and
    no group is larger than ``chunk + before + after``, however long a document
    is.  Positions of a document must be consecutive from 0.
    """
    if max(before, after) > chunk:
        raise ValueError("a window may reach into the next chunk only")
    if "ids" in encoded.columns:
        return chunks(encoded, before, after, with_keep, chunk)
    fields = ["pos", "token_id"] + (["keep"] if with_keep else [])
    own = F.floor(F.col("pos") / F.lit(chunk))
    place = F.col("pos") - own * chunk
    none = F.lit(None).cast("long")
    to = F.array_compact(F.array(own, F.when(place >= chunk - before, own + 1).otherwise(none) if before else none,
                                 F.when((place < after) & (own > 0), own - 1).otherwise(none) if after else none))
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (encoded.select("doc_id", *fields, F.explode(to).alias("chunk")).repartition(n, "doc_id", "chunk")
                .groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__s")))
    # A document that ends at a chunk's edge leaves a chunk with nothing of its own behind it.
    s = s.filter(F.col("__s")[F.size("__s") - 1]["pos"] >= F.col("chunk") * chunk)
    cols = ["doc_id", "chunk", F.col("__s")[0]["pos"].alias("first"), F.lit(chunk).alias("size"),
            F.transform("__s", lambda x: x["token_id"]).alias("ids")]
    if with_keep:
        cols.append(F.transform("__s", lambda x: x["keep"]).alias("keep"))
    return s.select(*cols)


def chunk_columns(arrays: DataFrame) -> list[str]:
    """What :func:`chunk_blocks` reads of whole documents or of chunks."""
    return ["doc_id", "ids"] + [c for c in ("chunk", "first", "size", "rare") if c in arrays.columns]


def symmetric_windows(arrays: DataFrame, radius: int = 3, dynamic: bool = False,
                      seed: int = 42, epoch: int = 0, only_kept: bool = False) -> DataFrame:
    """``(doc_id, pos, target_id, left, right[, keep])``.

    Targets are positions R <= i < n-R (none when n <= 2R).  With ``dynamic``
    the radius of each sample is uniform in [1, R] (seeded); the bounds still
    use R.  ``only_kept`` builds the windows of targets with ``keep`` alone.
    """
    if radius < 1:
        raise ValueError("radius must be >= 1")
    R, flagged = radius, "keep" in arrays.columns
    reach = np.arange(1, R + 1)

    def run(batches):
        for b, doc, pos, at in _sampled(batches, R, R, only_kept):
            ids = b.column("ids").values
            r = np.full(len(pos), R)
            if dynamic:
                docs = b.column("doc_id").to_pylist()
                u = _uniforms(f"{seed}|{epoch}|radius|", docs, doc, pos)
                r = np.floor(u * R).astype(np.int64) + 1
            inside = reach[None, :] <= r[:, None]
            columns = {"doc_id": b.column("doc_id").take(pa.array(doc)), "pos": pa.array(pos), "target_id": ids.take(pa.array(at)),
                       "left": _taken(ids, (at[:, None] - reach[None, ::-1])[inside[:, ::-1]], r),
                       "right": _taken(ids, (at[:, None] + reach[None, :])[inside], r)}
            if flagged:
                columns["keep"] = b.column("keep").values.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return arrays.select(*chunk_columns(arrays), *(["keep"] if flagged else [])).mapInArrow(
        run, _window_schema(arrays, left="list", right="list", **({"keep": "boolean"} if flagged else {})))


#: Ids whose windows are built together.
WINDOW_IDS = 1 << 16


def _sampled(batches, before: int, after: int, only_kept: bool = False):
    """Parts of Arrow batches of documents or chunks with the samples of each: (part, its rows, positions, places in the ids).

    Only positions with ``before`` ids ahead and ``after`` behind are sampled.
    """
    for batch in batches:
        ends = batch.column("ids").offsets.to_numpy()
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + WINDOW_IDS, side="right")) - 1)
            b, row = batch.slice(row, stop - row), stop
            start = b.column("ids").offsets.to_numpy().astype(np.int64)
            n = np.diff(start)
            if "chunk" in b.schema.names:
                chunk, first, size = (b.column(c).to_numpy().astype(np.int64) for c in ("chunk", "first", "size"))
                low, high = np.maximum(chunk * size, before), np.minimum((chunk + 1) * size - 1, first + n - 1 - after)
                low = np.maximum(low, first)
            else:
                first, low, high = np.zeros(len(n), np.int64), np.full(len(n), before, np.int64), n - 1 - after
            m = np.maximum(high - low + 1, 0)
            doc = np.repeat(np.arange(len(n)), m)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + low[doc]
            at = pos - first[doc] + start[doc]
            if only_kept:
                kept = b.column("keep").values.to_numpy(zero_copy_only=False).astype(bool)[at]
                doc, pos, at = doc[kept], pos[kept], at[kept]
            if len(doc):
                yield b, doc, pos, at


def _uniforms(prefix: str, docs: list, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``seeded_uniform`` of (prefix, document, position) for each sample."""
    out, last, start = np.empty(len(pos), np.uint32), None, None
    for k, (d, i) in enumerate(zip(doc.tolist(), pos.tolist(), strict=True)):
        if d != last:
            # concat_ws leaves a null doc_id out.
            last, start = d, hashlib.md5((prefix + ("" if docs[d] is None else f"{docs[d]}|")).encode())
        h = start.copy()
        h.update(b"%d" % i)
        out[k] = int.from_bytes(h.digest()[:4], "big")
    return out / 4294967296.0


def _taken(ids: pa.Array, places: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of ``lengths`` ids from ``places``, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), ids.take(pa.array(places)))


def _window_schema(arrays: DataFrame, **more) -> T.StructType:
    ids = arrays.schema["ids"].dataType
    kinds = {"list": T.ArrayType(ids.elementType), "boolean": T.BooleanType()}
    return T.StructType([arrays.schema["doc_id"], T.StructField("pos", T.LongType()), T.StructField("target_id", ids.elementType),
                         *[T.StructField(name, kinds[kind]) for name, kind in more.items()]])


def multi_hot(ids, cap: int | None = None) -> Column:
    """Sparse multi-hot indices - distinct and sorted.

    Indices need no width, so there is none by default.  A caller that asks
    for the width ``cap`` gets the indices below it; ``beyond`` counts the rest.
    """
    c = F.col(ids) if isinstance(ids, str) else ids
    # sort_array compares numbers as such, array_sort by a function; only the place of null differs.
    ordered = F.sort_array(F.array_distinct(c if cap is None else F.filter(c, lambda x: x < F.lit(cap))))
    null_last = lambda x: F.when((F.size(x) > 0) & F.get(x, F.lit(0)).isNull(), F.concat(F.slice(x, 2, F.size(x)), F.slice(x, 1, 1))).otherwise(x)
    return F.get(F.transform(F.array(ordered), null_last), F.lit(0))


def beyond(ids, cap: int) -> Column:
    """How many distinct indices a multi-hot row of width ``cap`` can't hold."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.size(F.array_distinct(F.filter(c, lambda x: x >= F.lit(cap)))).cast("long")


def _pairs(windows: DataFrame, inputs: Column, outputs: Column, cap: int | None) -> DataFrame:
    lost = [] if cap is None else [(beyond(inputs, cap) + beyond(outputs, cap)).alias("n_beyond")]
    return windows.select("doc_id", "pos", "target_id", multi_hot(inputs, cap).alias("inputs"),
                          multi_hot(outputs, cap).alias("outputs"), *lost)


def cbow_pairs(windows: DataFrame, cap: int | None = None) -> DataFrame:
    """Context set -> target (``inputs``, ``outputs`` as multi-hot indices; ``n_beyond`` with a ``cap``)."""
    return _pairs(windows, F.concat("left", "right"), F.array("target_id"), cap)


def skipgram_pairs(windows: DataFrame, cap: int | None = None) -> DataFrame:
    """Target -> context set (one multi-hot row per sample, not per pair; ``n_beyond`` with a ``cap``)."""
    return _pairs(windows, F.array("target_id"), F.concat("left", "right"), cap)


def embedding_samples(arrays: DataFrame, radius: int = 3, dynamic: bool = True,
                      method: str = "cbow", seed: int = 42, epoch: int = 0,
                      cap: int | None = None) -> DataFrame:
    """W1-W7 composed: sampled targets only (requires a ``keep`` array)."""
    w = symmetric_windows(arrays, radius, dynamic, seed, epoch, only_kept=True)
    if method == "cbow":
        return cbow_pairs(w, cap)
    if method == "skipgram":
        return skipgram_pairs(w, cap)
    raise ValueError("method must be 'cbow' or 'skipgram'")


def causal_windows(arrays: DataFrame, context_tokens: int = 16) -> DataFrame:
    """One sample per token: previous C ids, left-padded with id 0."""
    C = context_tokens
    back = np.arange(C, 0, -1)

    def run(batches):
        for b, doc, pos, at in _sampled(batches, 0, 0):
            ids = b.column("ids").values
            pad = (pos[:, None] < back[None, :]).ravel()
            places = (at[:, None] - back[None, :]).ravel()
            context = ids.take(pa.array(np.where(pad, 0, np.maximum(places, 0))))
            if pad.any():
                context = pc.if_else(pa.array(pad), pa.scalar(0, ids.type), context)
            offsets = pa.array(np.arange(0, (len(pos) + 1) * C, C, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(pos), ids.take(pa.array(at)),
                                              pa.ListArray.from_arrays(offsets, context)], ["doc_id", "pos", "target_id", "context_ids"])

    return arrays.select(*chunk_columns(arrays)).mapInArrow(run, _window_schema(arrays, context_ids="list"))


def shuffle_order(samples: DataFrame, seed: int = 42, keys=("doc_id", "pos")) -> DataFrame:
    """Seeded shuffle as a sort key; ``orderBy`` it only if a total order is needed."""
    return samples.withColumn("shuffle_key", seeded_uniform(seed, F.lit("shuffle"), *keys))


#: Buckets to a factor of two of the shuffle key; the k-th smallest key's bucket then holds about k / 23,600 rows.
KEY_BUCKETS = 1 << 14


def _key_bucket(u: Column) -> Column:
    """A number that never falls as ``u`` grows: the scaled logarithm, so that small keys are told apart as well as large ones."""
    return F.coalesce(F.floor(F.log2(F.when(u > 0, u)) * F.lit(KEY_BUCKETS)), F.lit(-64 * KEY_BUCKETS)).cast("long")


def _smallest(samples: DataFrame, u: str, keys, share: float, cap: int) -> Column:
    """Whether a row is among the first min(floor(share * n), cap) by (u, keys), by radix selection.

    One pass counts rows by bucket of ``u``; the driver sees at most 64 x
    ``KEY_BUCKETS`` counts, whatever the number of rows.  Only if the k-th row
    lies inside a bucket are that bucket's first rows fetched to find it.
    """
    bucket = _key_bucket(F.col(u))
    counts = sorted(samples.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    k = int(min(int(Decimal(sum(n for _, n in counts)) * Decimal(str(share))), cap))
    for b, n in counts:
        if k < n:
            break
        k -= n
    else:
        return F.lit(True) if counts else F.lit(False)
    if not k:
        return bucket < b
    order = [u, *keys]
    last = samples.filter(bucket == b).select(*order).orderBy(*order).limit(k).collect()[-1]
    row, edge = F.struct(*[F.col(c) for c in order]), F.struct(*[F.lit(x).cast(t) for x, (_, t) in zip(
        last, samples.select(*order).dtypes, strict=True)])
    # The row that ends the draw lies in bucket b, so what comes before it needs no bucket.
    return row <= edge


def train_validation_split(samples: DataFrame, seed: int = 42, share: float = 0.15,
                           cap: int = 10000, keys=("doc_id", "pos"), holdout: bool = False) -> DataFrame:
    """Flag the first min(floor(share * n), cap) rows of a second seeded shuffle.

    The k-th row of the shuffle is found by :func:`_smallest`, rows are flagged
    by comparing with it: no table is written and nothing is joined.
    ``samples`` is evaluated three times at most, so what is costly before it is better
    stored by the caller.  ``keys`` name the rows; rows that share them share
    the flag.  By default validation rows
    stay in training, as in the reference; ``holdout=True`` removes them.
    """
    # The key is a column of its own, so that no pass draws it twice for a row.
    drawn = samples.withColumn("__u", seeded_uniform(seed, F.lit("validation"), *keys))
    out = drawn.withColumn("validation", _smallest(drawn, "__u", keys, share, cap)).drop("__u")
    return out.filter(~F.col("validation")) if holdout else out


# ---- W8-W10: next-token feature rows, built per document in Arrow batches ----

def positional_table(max_position: int, dim: int, period: int, first: int = 0) -> np.ndarray:
    """sin(2*pi*p/period/k) for first <= p < max_position, k = 1..dim; position 0 gives zeros."""
    if period == 0:
        return np.zeros((max_position - first, dim))
    p = np.arange(first, max_position, dtype=np.float64)[:, None]
    k = np.arange(1, dim + 1, dtype=np.float64)[None, :]
    return np.sin(2.0 * np.pi * p / float(period) / k)


def window_features(ids: np.ndarray, matrix: np.ndarray, has: np.ndarray, C: int, period: int,
                    align_positions: bool = False, first: int = 0, last: int | None = None, origin: int = 0):
    """Features of a document's positions ``first <= i < last`` (numpy; shared by W9 and L3).

    ``ids[0]`` stands at position ``origin``.
    Returns (positions, target_ids, X (m, C*d), Y (m, d)) for the samples whose
    target and context tokens all have a vector (W10).
    """
    n = origin + len(ids) if last is None else min(last, origin + len(ids))
    d = matrix.shape[1]
    if n <= first:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, C * d)), np.zeros((0, d)))
    index = np.arange(first, n)[:, None]
    slot = np.arange(C)[None, :]
    src = index - C + slot                       # source position of each slot
    pad = src < 0
    ctx = np.where(pad, 0, ids[np.clip(src - origin, 0, None)])
    if align_positions:
        pos = index + slot                       # generation numbering
    else:
        # Training numbering: paddings 0.., tokens index + i.
        first_tok = np.maximum(C - index, 0)
        pos = np.where(pad, slot, index + slot - first_tok)
    safe = lambda a: np.clip(a, 0, len(has) - 1)
    in_range = lambda a: (a >= 0) & (a < len(has))
    ctx_ok = pad | (in_range(ctx) & has[safe(ctx)])
    own = ids[first - origin:n - origin]
    tgt_ok = in_range(own) & has[safe(own)]
    ok = tgt_ok & ctx_ok.all(axis=1)
    sel = np.nonzero(ok)[0]
    if sel.size == 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, C * d)), np.zeros((0, d)))
    at, low = pos[sel], int(pos[sel].min())
    pe = positional_table(int(at.max()) + 1, d, period, low)
    vec = np.where(pad[sel][:, :, None], 0.0, matrix[safe(ctx[sel])])
    X = (vec + pe[at - low]).reshape(sel.size, C * d)
    Y = matrix[own[sel]].astype(np.float64)
    return sel.astype(np.int64) + first, own[sel].astype(np.int64), X, Y


def window_blocks(ids: np.ndarray, matrix: np.ndarray, has: np.ndarray, C: int, period: int,
                  align_positions: bool = False, rows: int = 1024, low: int = 0, high: int | None = None, origin: int = 0):
    """``window_features`` of the positions ``low <= i < high``, ``rows`` at a time; blocks without a sample are left out."""
    high = origin + len(ids) if high is None else min(high, origin + len(ids))
    for first in range(low, high, rows):
        block = window_features(ids, matrix, has, C, period, align_positions, first, min(first + rows, high), origin)
        if len(block[0]):
            yield block


def chunk_blocks(batches, matrix: np.ndarray, has: np.ndarray, C: int, period: int, align_positions: bool = False,
                 rows: int = 1024):
    """``(doc_id, positions, target_ids, X, Y)`` for Arrow batches of whole documents or of chunks.

    ``matrix, has`` are laid out by id, or, if the batches bring the vectors of
    their rare ids, ``matrix`` is that of the ids ``has`` (:func:`vector_source`).
    """
    for doc, one, low, high, origin, known, mat, hv in _with_vectors(batches, matrix, has):
        for pos, target, X, Y in window_blocks(one, mat, hv, C, period, align_positions, rows, low, high, origin):
            yield doc, pos, target if known is None else known[target], X, Y


#: Tokens whose windows slide over one block, which a core's cache holds.
SLIDE_TOKENS = 1 << 11


def sliding_blocks(batches, matrix: np.ndarray, has: np.ndarray, C: int, period: int, align_positions: bool = False,
                   tokens: int = SLIDE_TOKENS):
    """The samples of :func:`chunk_blocks` without a copy of each token for each of its C windows.

    From position C on a token's features do not depend on the window: slot
    ``a`` of sample ``i`` is row ``i - C + a`` of one table.  Yields
    ``(heads, slide)``: lists of ``(doc_id, positions, target_ids, X, Y)`` of the
    samples before C, and, or None, ``(doc_ids, row, positions, ids, encoded, vectors,
    sampled)`` of documents or chunks end to end, a row for each token; the
    features of a ``sampled`` row ``i`` are ``encoded[i - C:i]``.
    """
    table = None
    heads, parts, held = [], [], 0

    def block():
        if not parts:
            return heads, None
        row = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
        return heads, ([x[0] for x in parts], row, *(np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]))

    for doc, one, low, high, origin, known, mat, hv in _with_vectors(batches, matrix, has):
        end = origin + len(one) if high is None else min(high, origin + len(one))
        if low < min(C, end):
            pos, target, X, Y = window_features(one, mat, hv, C, period, align_positions, low, min(C, end), origin)
            if len(pos):
                heads.append((doc, pos, target if known is None else known[target], X, Y))
                held += len(pos)
        d = mat.shape[1]
        if table is None:
            table = positional_table(2 * CHUNK, d, period)
        step = max(tokens, C)
        for first in range(max(low, C), end, step):
            last = min(first + step, end)
            ids = one[first - C - origin:last - origin]
            ok = (ids >= 0) & (ids < len(hv))
            safe = np.where(ok, ids, 0)
            ok &= hv[safe]
            bad = np.concatenate([[0], np.cumsum(~ok)])
            sampled = np.zeros(len(ids), bool)
            sampled[C:] = bad[C + 1:] == bad[:-C - 1]
            if not sampled.any():
                continue
            vectors = mat[safe].astype(np.float64)
            vectors[~ok] = 0.0
            pe = table[first:last + C] if last + C <= len(table) else positional_table(last + C, d, period, first)
            encoded = vectors + pe
            parts.append((doc, np.arange(first - C, last), ids if known is None else known[ids], encoded, vectors, sampled))
            held += len(ids)
            if held >= tokens:
                yield block()
                heads, parts, held = [], [], 0
        if held >= tokens:
            yield block()
            heads, parts, held = [], [], 0
    if held:
        yield block()


def _with_vectors(batches, matrix: np.ndarray, has: np.ndarray):
    """``(doc_id, ids, low, high, origin, known, matrix, has)`` of each document or chunk; ``known``: what its ids are places in, if local."""
    for batch in batches:
        docs, ids = batch.column("doc_id").to_pylist(), id_lists(batch.column("ids"))
        if "chunk" in batch.schema.names:
            chunk, first, size = (batch.column(k).to_numpy() for k in ("chunk", "first", "size"))
            ranges = zip((chunk * size).tolist(), ((chunk + 1) * size).tolist(), first.tolist(), strict=True)
        else:
            ranges = ((0, None, 0) for _ in docs)
        rare = iter(batch.column("rare")) if "rare" in batch.schema.names else None
        for doc, one, (low, high, origin) in zip(docs, ids, ranges, strict=True):
            if rare is None:
                yield doc, one, low, high, origin, None, matrix, has
            else:
                known, local, places, own = _local_vectors(one, matrix, has, next(rare))
                yield doc, places, low, high, origin, known, local, own


def _local_vectors(ids: np.ndarray, matrix: np.ndarray, hot: np.ndarray, rare):
    """(distinct ids, their vectors, the ids as places among them, which have a vector)."""
    known, places = np.unique(ids, return_inverse=True)
    local, has = np.zeros((len(known), matrix.shape[1]), np.float32), np.zeros(len(known), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
        has = hot[at] == known
        local[has] = matrix[at[has]]
    if rare.is_valid and len(rare.values):
        at = np.searchsorted(known, rare.values.field("token_id").to_numpy())
        local[at] = rare.values.field("embedding").flatten().to_numpy().reshape(len(at), -1)
        has[at] = True
    return known, local, places.astype(np.int64), has


def id_lists(column: pa.Array):
    """Each row's ids as a view of the column's values (empty for null)."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].astype(np.int64, copy=False) for a, b in zip(at[:-1], at[1:], strict=True)]


#: Largest vector matrix, in bytes of float32, that goes through the driver into a broadcast.
BROADCAST_BYTES = 128 << 20
#: Largest matrix of the most frequent ids' vectors, in the same bytes, that is broadcast of a larger table.
HOT_BYTES = 64 << 20


def vectors_fit_broadcast(vectors: DataFrame, max_rows: int | None = None,
                          max_bytes: int = BROADCAST_BYTES, id_col: str | None = "token_id") -> bool:
    """Size check deciding between the broadcast and the shuffle-join forms.

    Measures the matrix itself: its rows (to the largest id where the matrix
    is laid out by ``id_col``) times the vector length.
    """
    count = F.count(F.lit(1))
    n, span, d = vectors.select(count, F.max(id_col) + 1 if id_col else count, F.max(F.size("embedding"))).first()
    return (max_rows is None or n <= max_rows) and (span or 0) * (d or 0) * 4 <= max_bytes


def vector_matrix(vectors: DataFrame, max_bytes: int = BROADCAST_BYTES):
    """Collect an id-keyed vector table ``(token_id, embedding)`` as a matrix with a row per id.

    A matrix above ``max_bytes`` is refused rather than pulled to the driver.
    """
    if not vectors_fit_broadcast(vectors, max_bytes=max_bytes):
        raise ValueError(f"the vector matrix is above the broadcast bound of {max_bytes} bytes")
    got = vectors.select("token_id", F.col("embedding").cast("array<float>")).toArrow()
    if not got.num_rows:
        return np.zeros((1, 0), np.float32), np.zeros(1, bool)
    ids = got.column(0).to_numpy()
    rows = got.column(1).combine_chunks()
    matrix = np.zeros((int(ids.max()) + 1, len(rows[0])), dtype=np.float32)
    has = np.zeros(len(matrix), dtype=bool)
    matrix[ids] = rows.flatten().to_numpy().reshape(len(ids), -1)
    has[ids] = True
    return matrix, has


FEATURE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("target", T.ArrayType(T.DoubleType())),
])


def _list_array(block: np.ndarray) -> pa.Array:
    m, w = block.shape
    offsets = pa.array(np.arange(0, (m + 1) * w, w, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(block.reshape(-1)))


def vector_source(arrays: DataFrame, vectors: DataFrame, max_rows: int | None = None, max_bytes: int = HOT_BYTES):
    """``(arrays, matrix, has)`` for :func:`chunk_blocks`, whatever the size of ``vectors``.

    A matrix within ``BROADCAST_BYTES`` (and ``max_rows``, if given) is laid out
    by id, to be broadcast.  Of a larger table only the vectors of the ids that
    occur most often are, up to ``max_bytes``; each other id's vector is joined
    once to every document or chunk that has the id (column ``rare``).  A window
    or its features are never rows of the shuffle.  Counts are taken from
    ``vectors`` where it has ``occurrences``.
    """
    if vectors_fit_broadcast(vectors, max_rows):
        return arrays, *vector_matrix(vectors)
    # Stored with a number for each row, as doc_ids may repeat or be null.
    stored = materialize(arrays.withColumn("row", F.monotonically_increasing_id()))
    ids = stored.select(F.explode("ids").alias("token_id"))
    v = vectors.select("token_id", F.col("embedding").cast("array<float>").alias("embedding"),
                       *(["occurrences"] if "occurrences" in vectors.columns else []))
    if "occurrences" not in vectors.columns:
        v = v.join(ids.groupBy("token_id").agg(F.count(F.lit(1)).alias("occurrences")), "token_id")
    v = materialize(v)
    d = v.select(F.max(F.size("embedding"))).first()[0] or 0
    most = min(max_bytes // (4 * max(1, d)), max_bytes if max_rows is None else max_rows)
    least = least_count(v, most)
    hot = v.filter(F.col("occurrences") >= least) if least is not None else v.limit(0)
    got = hot.select("token_id", "embedding").toArrow().sort_by("token_id")
    matrix = (got.column(1).combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1) if got.num_rows
              else np.zeros((0, d), np.float32))
    cold = (v.filter(F.col("occurrences") < least) if least is not None else v).select("token_id", "embedding")
    rare = (stored.select("row", F.explode(F.array_distinct("ids")).alias("token_id"))
            .join(F.broadcast(hot.select("token_id")), "token_id", "left_anti").join(cold, "token_id")
            .groupBy("row").agg(F.collect_list(F.struct("token_id", "embedding")).alias("rare")))
    n = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.repartition(n, "row").join(rare, "row", "left").drop("row"), matrix, got.column(0).to_numpy()


def next_token_features(arrays: DataFrame, vectors: DataFrame, context_tokens: int = 16,
                        period: int = 5000, align_positions: bool = False,
                        chunk: int = 1024, max_broadcast_rows: int | None = None, summary=None) -> DataFrame:
    """``(doc_id, pos, target_id, features ARRAY<DOUBLE>(C*d), target ARRAY<DOUBLE>)``.

    A vector matrix within ``BROADCAST_BYTES`` (and ``max_broadcast_rows``, if
    given) is broadcast and windows are built in NumPy, about ``chunk`` positions
    at a time; beyond it, rare ids' vectors come with their document
    (:func:`vector_source`).

    ``summary = (function, schema)``: what ``function(X, Y)`` returns for a
    block of samples, an array for each column of the schema, stands in for the
    two wide columns.  The features, some kilobytes a sample, are built all the
    same, but need not leave their task.
    """
    spark = arrays.sparkSession
    arrays, matrix, has = vector_source(arrays, vectors, max_broadcast_rows)
    bc = spark.sparkContext.broadcast((matrix, has))
    C = context_tokens
    function, more = summary or (None, FEATURE_SCHEMA[3:])
    schema = T.StructType([*FEATURE_SCHEMA[:3], *more])
    names = schema.names

    def rows(docs, pos, target, X, Y):
        wide = [pa.array(c) for c in function(X, Y)] if function else [_list_array(X), _list_array(Y)]
        return pa.RecordBatch.from_arrays([docs, pa.array(pos), pa.array(target), *wide], names)

    def run(batches):
        single_thread_blas()
        mat, hv = bc.value
        for heads, slide in sliding_blocks(batches, mat, hv, C, period, align_positions, chunk):
            for doc, pos, target, X, Y in heads:
                yield rows(pa.repeat(pa.scalar(doc, pa.int64()), len(pos)), pos, target, X, Y)
            if slide is not None:
                docs, row, pos, ids, encoded, vectors, sampled = slide
                at, d = np.flatnonzero(sampled), encoded.shape[1]
                docs = pa.array(docs, pa.int64())
                windows = np.lib.stride_tricks.sliding_window_view(encoded.ravel(), C * d)
                for some in np.split(at, range(chunk, len(at), chunk)):
                    if len(some):
                        yield rows(docs.take(pa.array(row[some])), pos[some].astype(np.int64), ids[some].astype(np.int64),
                                   windows[(some - C) * d], vectors[some])

    return arrays.select(*chunk_columns(arrays)).mapInArrow(run, schema)
