"""Token embeddings from training samples by a linear sketch (L1, L2).

A token's row of the co-occurrence matrix counts, over all samples (W1-W7),
which outputs stand beside it as an input.  The row is never stored: every
output adds its own signs, one per dimension, so the embedding is the sum of
the signs of everything a token met (a random projection of its row).  Sums
merge in any order: tasks combine them before the shuffle, new samples can be
added to an old sketch, and no weights pass through the driver.  Sampling
method, radius, subsampling and seed change the samples and so the vectors.

Signs are hex digits of ``md5(seed|sign|block|id)``: reproducible in SQL, and
independent of partitioning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NO_ID
from .joins import salted_lookup

#: Signs that one md5 has.
DIGITS = 32


def sign_digits(token_id, dims: int, seed: int = 42) -> Column:
    """Hex digits of the signs of ``dims`` dimensions; 8 to f are +1, 0 to 7 are -1."""
    i = F.col(token_id) if isinstance(token_id, str) else token_id
    blocks = -(-dims // DIGITS)
    return F.concat(*[F.md5(F.concat_ws("|", F.lit(seed), F.lit("sign"), F.lit(b), i.cast("string"))) for b in range(blocks)])


def sample_pairs(samples: DataFrame) -> DataFrame:
    """``token_id, other`` for every input and every output of a W3 or W4 sample."""
    one = samples.select(F.explode("inputs").alias("token_id"), "outputs")
    return one.select("token_id", F.explode("outputs").alias("other"))


def cooccurrence_sketch(samples: DataFrame, dims: int = 16, seed: int = 42) -> DataFrame:
    """L1: ``token_id, n_pairs, sums ARRAY<LONG>`` of every token that is an input of a sample.

    ``sums[k]`` adds the k-th sign of every output the token met.  A task adds up
    the signs of about ``2**24 / dims`` pairs at a time in NumPy, drawing the signs
    of an output once; a hash aggregate adds up those rows.
    """
    kind = samples.schema["inputs"].dataType.elementType
    names = [f"p{k}" for k in range(dims)]
    most = max(1 << 14, (1 << 24) // dims)

    def run(batches):
        kept, n = [], 0
        for b in batches:
            for start in range(0, b.num_rows, PAIR_SAMPLES):
                kept.append(_pair_ids(b.slice(start, PAIR_SAMPLES)))
                n += len(kept[-1][0])
                if n >= most:
                    yield from _positive_signs(kept, dims, seed, names)
                    kept, n = [], 0
        yield from _positive_signs(kept, dims, seed, names)

    counted = samples.select("inputs", "outputs").mapInArrow(
        run, f"token_id {kind.simpleString()}, n_pairs long" + "".join(f", {c} long" for c in names))
    counts = counted.groupBy("token_id").agg(F.sum("n_pairs").alias("n_pairs"), *[F.sum(c).alias(c) for c in names])
    # A digit from 8 on is a positive sign; the sum of signs is twice their number less all.
    return counts.select("token_id", "n_pairs", F.array(*[2 * F.col(c) - F.col("n_pairs") for c in names]).alias("sums"))


#: Samples whose pairs are listed together.
PAIR_SAMPLES = 1 << 14


def _pair_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.DataType]:
    """:func:`sample_pairs` of a batch: inputs, outputs (``NO_ID`` for null), the inputs' type."""
    lists = [batch.column("inputs"), batch.column("outputs")]
    n, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    ids, others = (pc.fill_null(x.flatten().cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False) for x in lists)
    each = n * m
    row = np.repeat(np.arange(len(each)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return ids[(np.cumsum(n) - n)[row] + k // m[row]], others[(np.cumsum(m) - m)[row] + k % m[row]], lists[0].type.value_type


def _positive_signs(kept: list, dims: int, seed: int, names: list):
    """A batch with a row for each different input: how many pairs it has, and how many positive signs in each dimension."""
    if not sum(len(x[0]) for x in kept):
        return
    ids, others = (np.concatenate([x[i] for x in kept]) for i in (0, 1))
    known, place = np.unique(others, return_inverse=True)
    blocks = -(-dims // DIGITS)
    # concat_ws leaves a null id out.
    digest = b"".join(hashlib.md5(b"%s|sign|%d" % (str(seed).encode(), k) + (b"" if i == NO_ID else b"|%d" % i)).digest()
                      for i in known.tolist() for k in range(blocks))
    # The first bit of each hex digit.
    signs = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(len(known), -1), axis=1)[:, ::4][:, :dims]
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.concatenate([[0], np.nonzero(np.diff(ids))[0] + 1])
    positive = np.add.reduceat(signs[place[order]].astype(np.int32), first, axis=0).astype(np.int64)
    tokens = ids[first]
    columns = [pa.array(tokens, mask=tokens == NO_ID).cast(kept[0][2]), pa.array(np.diff(first, append=len(ids)).astype(np.int64))]
    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(c)) for c in positive.T]], ["token_id", "n_pairs", *names])


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all samples together, from those of parts of them."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    dims = every.select(F.max(F.size("sums"))).first()[0] or 0
    if not dims:
        return every
    return every.groupBy("token_id").agg(
        F.sum("n_pairs").alias("n_pairs"), F.array(*[F.sum(F.col("sums")[k]) for k in range(dims)]).alias("sums"))


def unit_vector(sums) -> Column:
    """Integer sums as ARRAY<FLOAT> of length one; null for zeros."""
    s = F.col(sums) if isinstance(sums, str) else sums
    norm = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(s, lambda x: (x / norm).cast("float")))


def fit_cooccurrence(samples: DataFrame, dims: int = 16, seed: int = 42) -> DataFrame:
    """L1: ``token_id, n_pairs, embedding ARRAY<FLOAT>`` from W3 or W4 samples."""
    return cooccurrence_sketch(samples, dims, seed).select("token_id", "n_pairs", unit_vector("sums").alias("embedding"))


def token_grams(tokens: DataFrame, n: int = 3) -> DataFrame:
    """``tokens`` with a row for every distinct ``gram``: n characters of the token between boundary marks.

    A token shorter than a gram with its marks is one gram.
    """
    marked = F.concat(F.lit("\x02"), F.col("token"), F.lit("\x03"))
    at = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
    return tokens.withColumn("gram", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(marked, i, F.lit(n))))))


def embed_all_tokens(vocab: DataFrame, sketch: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """L2: ``token_id, token, source, sums, embedding`` for every token of the vocabulary.

    ``source`` is ``learned`` (the token is in the sketch), ``composed`` (the
    sums of the learned tokens that share a gram with it, once for each shared
    gram) or ``hashed`` (no learned token shares a gram: its own signs).  Grams
    that many tokens have are looked up by the hot-key join.
    """
    dims = sketch.select(F.max(F.size("sums"))).first()[0] or 1
    known = vocab.select("token_id", "token").join(sketch.select("token_id", "sums"), "token_id", "left")
    learned = known.filter(F.col("sums").isNotNull())
    grams = (token_grams(learned, n).groupBy("gram")
             .agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(dims)]).alias("gram_sums"), F.count(F.lit(1)).alias("n_tokens")))
    asked = token_grams(known.filter(F.col("sums").isNull()).select("token_id", "token"), n)
    # A gram that many learned tokens have is one that many others have, too.
    met = salted_lookup(asked, grams, "gram", weight_col="n_tokens", how="left", salt_cols=["token_id"])
    composed = met.groupBy("token_id", "token").agg(F.array(*[F.sum(F.col("gram_sums")[k]) for k in range(dims)]).alias("sums"))
    digits = sign_digits("token_id", dims, seed)
    own = F.array(*[F.when(F.substring(digits, k + 1, 1) >= "8", 1).otherwise(-1).cast("long") for k in range(dims)])
    unknown = F.col("sums")[0].isNull()
    rows = learned.select("token_id", "token", F.lit("learned").alias("source"), "sums").unionByName(
        composed.select("token_id", "token", F.when(unknown, "hashed").otherwise("composed").alias("source"),
                        F.when(unknown, own).otherwise(F.col("sums")).alias("sums")))
    return rows.withColumn("embedding", unit_vector("sums"))
