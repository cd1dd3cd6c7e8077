"""Vocabulary statistics and token lookups.

Plan of a full build (``tokens update``):
``scan -> tokenize -> posexplode -> partial agg -> exchange(token) -> final agg``
then a range exchange for the dense ids and a scalar subquery for the total.
Hot tokens are combined map-side by the partial aggregate, so the exchange
carries at most one row per (task, token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize_document
from ..session import materialize
from .arrays import count_array_tokens, encode_arrays
from .ids import dense_ids
from .joins import heavy_hitters, salted_lookup

# First appearance is (doc_id, pos) ordered lexicographically.  It is packed
# into one DECIMAL(38,0) = doc_id * 2^31 + pos (pos < 2^31: Spark arrays are
# int-indexed), so ``min`` runs in the hash aggregate instead of a sort.
_POS_SPAN = 2 ** 31
_FIRST_TYPE = "decimal(38,0)"


def first_seen_key(doc_id="doc_id", pos="pos") -> Column:
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    p = F.col(pos) if isinstance(pos, str) else pos
    return (d.cast(_FIRST_TYPE) * F.lit(_POS_SPAN).cast(_FIRST_TYPE) + p.cast(_FIRST_TYPE)).cast(_FIRST_TYPE)


def token_occurrences(docs: DataFrame, lowercase: bool = False, strip_punctuation: bool = False,
                      keep_whitespace: bool = False) -> DataFrame:
    """D2 exploded: ``(doc_id, pos, token)`` for every token of every document."""
    toks = tokenize_document("input", "context", "output", lowercase, strip_punctuation,
                             keep_whitespace)
    return (docs.select("doc_id", F.posexplode(toks).alias("pos", "token"))
                .withColumn("pos", F.col("pos").cast("long")))


def token_arrays(docs: DataFrame, lowercase: bool = False, strip_punctuation: bool = False,
                 keep_whitespace: bool = False) -> DataFrame:
    """D2 as ``(doc_id, tokens)``: a row for each document, the token of position i at i."""
    return docs.select("doc_id", tokenize_document("input", "context", "output", lowercase, strip_punctuation,
                                                   keep_whitespace).alias("tokens"))


def count_tokens(occ: DataFrame) -> DataFrame:
    """V1: ``(token, occurrences, first_seen)`` per distinct token.

    Documents as arrays (``token_arrays``) are counted where they are read: a row
    for each different token of an Arrow batch goes on, not one for each token.
    """
    if "tokens" in occ.columns:
        return count_array_tokens(occ).groupBy("token").agg(
            F.sum("n").alias("occurrences"), F.min(first_seen_key()).alias("first_seen"))
    return occ.groupBy("token").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min(first_seen_key()).alias("first_seen"),
    )


def with_frequency(vocab: DataFrame) -> DataFrame:
    """V3: frequency = occurrences / total, total as a scalar subquery."""
    total = vocab.select(F.sum("occurrences")).scalar()
    return vocab.withColumn("frequency", F.col("occurrences").cast("double") / total.cast("double"))


def vocabulary_counts(occ: DataFrame) -> DataFrame:
    """V1 + V3 without ids: ``(token, occurrences, frequency)``.

    The counts are materialized first so the total (a scalar subquery) reads
    the small count table instead of re-running the corpus aggregate.
    """
    return with_frequency(materialize(count_tokens(occ).drop("first_seen")))


def build_vocabulary(occ: DataFrame, keep_first_seen: bool = False) -> DataFrame:
    """V1-V3: ``(token_id, token, occurrences, frequency)``, ids 1..V by first appearance."""
    # dense_ids materializes the counts; the total then reads that table.
    vocab = with_frequency(dense_ids(count_tokens(occ), ["first_seen"], id_col="token_id", start=1))
    cols = ["token_id", "token", "occurrences", "frequency"] + (["first_seen"] if keep_first_seen else [])
    return vocab.select(*cols)


def token_sketch(occ: DataFrame, lg_k: int = 12) -> DataFrame:
    """V4, mergeable: one row ``sketch`` of the distinct tokens, to be stored with the vocabulary.

    A relative standard error of about ``1 / sqrt(2 ** lg_k)``.
    """
    return occ.agg(F.hll_sketch_agg("token", lg_k).alias("sketch"))


def merge_token_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows together, from those of parts of them."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimate(sketch: DataFrame) -> DataFrame:
    """V4: the number of distinct tokens that a sketch stands for (one row)."""
    return sketch.select(F.hll_sketch_estimate("sketch").alias("n_distinct"))


def distinct_token_count(occ: DataFrame, approximate: bool = False) -> DataFrame:
    """V4: number of distinct tokens (one row)."""
    agg = F.approx_count_distinct("token") if approximate else F.count_distinct("token")
    return occ.agg(agg.cast("long").alias("n_distinct"))


def _max_id(vocab: DataFrame) -> int:
    return int(vocab.agg(F.coalesce(F.max("token_id"), F.lit(0))).first()[0])


def merge_vocabulary(vocab: DataFrame, delta_occ: DataFrame) -> DataFrame:
    """V5: add the counts of new token occurrences to an existing vocabulary.

    Old ids are kept; new tokens get ids after the current maximum in order of
    first appearance inside the delta; every frequency is recomputed.
    """
    delta = count_tokens(delta_occ).withColumnRenamed("occurrences", "delta_occ")
    # Known and new tokens and the total read the stored join: the delta is counted once.
    joined = materialize(vocab.select("token_id", "token", "occurrences").join(delta, "token", "full"))
    known = (joined.filter(F.col("token_id").isNotNull())
                   .select("token_id", "token",
                           (F.col("occurrences") + F.coalesce(F.col("delta_occ"), F.lit(0))).alias("occurrences")))
    fresh = joined.filter(F.col("token_id").isNull()).select(
        "token", F.col("delta_occ").alias("occurrences"), "first_seen")
    fresh = dense_ids(fresh, ["first_seen"], id_col="token_id", start=_max_id(vocab) + 1)
    merged = known.unionByName(fresh.select("token_id", "token", "occurrences"))
    return with_frequency(merged).select("token_id", "token", "occurrences", "frequency")


def extend_vocabulary(vocab: DataFrame, occ: DataFrame) -> DataFrame:
    """Unknown tokens of ``occ`` are appended with occurrences 1 each.

    Known tokens keep their counts (encoding looks them up, it does not count
    them); ids of new tokens follow first appearance; frequencies recomputed.
    """
    # One row per token before the join, so that only distinct tokens are shuffled to it.
    unknown = (occ.groupBy("token").agg(F.min(first_seen_key()).alias("first_seen"))
                  .join(vocab.select("token"), "token", "left_anti"))
    fresh = dense_ids(unknown, ["first_seen"], id_col="token_id", start=_max_id(vocab) + 1)
    merged = vocab.select("token_id", "token", "occurrences").unionByName(
        fresh.select("token_id", "token", F.lit(1).cast("long").alias("occurrences")))
    return with_frequency(merged).select("token_id", "token", "occurrences", "frequency")


def encode_tokens(occ: DataFrame, vocab: DataFrame, how: str = "inner",
                  hot_share: float = 1e-4, salt_buckets: int = 32) -> DataFrame:
    """``(doc_id, pos, token)`` -> adds ``token_id`` (null when absent for left).

    Documents as arrays (``token_arrays``) give ``(doc_id, pos, ids)``, see :mod:`.arrays`;
    their tokens are not shuffled one by one.
    """
    if "tokens" in occ.columns:
        return encode_arrays(occ, vocab, how)
    dim = vocab.select("token", "token_id", "occurrences")
    return salted_lookup(occ, dim, "token", weight_col="occurrences", how=how,
                         hot_share=hot_share, salt_buckets=salt_buckets,
                         salt_cols=["doc_id", "pos"]).drop("occurrences")


def decode_ids(ids: DataFrame, vocab: DataFrame, id_col: str = "token_id", how: str = "left") -> DataFrame:
    """Token id -> token (null when absent).

    Ids that many rows have are looked up map-side; the vocabulary's counts tell
    which, or a sketch of the rows where it has none.
    """
    known = "occurrences" in vocab.columns
    dim = vocab.select(F.col("token_id").alias(id_col), "token", *(["occurrences"] if known else []))
    out = salted_lookup(ids, dim, id_col, weight_col="occurrences" if known else None, how=how, hot_share=1e-3,
                        hot=None if known else heavy_hitters(ids, id_col))
    return out.drop("occurrences") if known else out


def token_by_value(vocab: DataFrame, token: str) -> DataFrame:
    """J1 point form: at most one row; pushdown-friendly filter."""
    return vocab.filter(F.col("token") == F.lit(token))


def token_by_id(vocab: DataFrame, token_id: int) -> DataFrame:
    """J2 point form."""
    return vocab.filter(F.col("token_id") == F.lit(token_id).cast("long"))


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a vocabulary table (Parquet); write a new path and swap for atomic updates."""
    vocab.select("token_id", "token", "occurrences", "frequency").write.mode(mode).parquet(path)


def read_vocabulary(spark, path: str, ordered: bool = False) -> DataFrame:
    """Scan a vocabulary table; ``ordered`` adds a range sort by id."""
    v = spark.read.parquet(path)
    return v.orderBy("token_id") if ordered else v
