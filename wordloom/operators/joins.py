"""Lookup joins that stay balanced when a few keys carry most of the rows.

A token stream is extremely skewed: section tags occur once per document and
punctuation is everywhere.  ``salted_lookup`` resolves hot keys map-side with
a broadcast of their dimension rows and spreads their fact rows over the
shuffle of the remaining join.  The hot set comes from known counts
(``weight_col``) or from a sketch of the fact rows (``heavy_hitters``): a key is
hot when its count is at least ``hot_share`` of the total, so there are at most
``1 / hot_share`` hot keys - a proven bound, which is why that set (and only
that set) is broadcast.  The large join itself is left to Catalyst / AQE,
which broadcasts the dimension only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_HOT, _SALT = "__wl_hot", "__wl_salt"


def hot_keys(dim: DataFrame, key: str, weight_col: str, hot_share: float = 1e-4) -> DataFrame:
    """Keys whose weight is >= hot_share * total weight (<= 1/hot_share rows)."""
    total = dim.select(F.sum(weight_col)).scalar()
    return (dim.filter(F.col(weight_col) >= total * F.lit(float(hot_share)))
               .select(key, F.lit(True).alias(_HOT)))


def heavy_hitters(facts: DataFrame, key: str, hot_share: float = 1e-3, tracked: int = 20_000) -> DataFrame:
    """Keys of at least ``hot_share`` of the rows, from one aggregate over the rows themselves.

    The frequent-items sketch keeps ``tracked`` counters, combines in the map
    tasks and never counts too low by more than a few parts in ``tracked``; a key
    may be taken for hot though it is a little below the share.  At most
    ``2 / hot_share`` keys are returned (a stored table); null is never hot.
    """
    most = int(2 / hot_share)
    counted = facts.agg(F.expr(f"approx_top_k(`{key}`, {most}, {max(tracked, 4 * most)})").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = counted.select(F.explode("top").alias("x"), "n").filter(
        F.col("x.item").isNotNull() & (F.col("x.count") >= F.col("n") * hot_share))
    return materialize(rows.select(F.col("x.item").alias(key)))


def salted_lookup(facts: DataFrame, dim: DataFrame, key: str, *, weight_col: str | None = None,
                  how: str = "inner", hot_share: float = 1e-4, salt_buckets: int = 64,
                  salt_cols: list | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join ``facts`` to a dimension with unique ``key`` (inner or left).

    One pass over ``facts``:

    1. hot keys (bounded set, see module doc) are resolved map-side by a
       broadcast join against the hot slice of the dimension;
    2. the remaining equi-join runs on ``(key, salt)``: cold rows carry salt 0
       and meet the dimension normally, hot rows carry a salt in
       1..salt_buckets (hash of ``salt_cols``) that matches nothing, as do
       rows without a key, so they
       are spread over the shuffle instead of piling into one partition.

    Catalyst / AQE still choose broadcast or sort-merge for step 2 from the
    measured size of the dimension.

    The hot keys come from known counts (``weight_col``) or, where there are
    none, from a table of them (``hot``, see :func:`heavy_hitters`).
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_lookup supports inner and left joins")
    if weight_col is None and hot is None:
        return facts.join(dim, key, how)
    dim_cols = [c for c in dim.columns if c != key]
    hot = hot_keys(dim, key, weight_col, hot_share) if hot is None else hot
    hot_dim = F.broadcast(dim.join(hot, key, "left_semi")
                             .select(key, *[F.col(c).alias("__hot_" + c) for c in dim_cols])
                             .withColumn(_HOT, F.lit(True)))
    cols = salt_cols or [c for c in facts.columns if c != key]
    staged = (facts.join(hot_dim, key, "left")
                   .withColumn(_SALT, F.when(F.col(_HOT) | F.col(key).isNull(), F.pmod(F.xxhash64(*cols), F.lit(salt_buckets)) + 1)
                                       .otherwise(F.lit(0)).cast("int")))
    cold_dim = dim.withColumn(_SALT, F.lit(0))
    joined = staged.join(cold_dim, [key, _SALT], "left")
    out = joined.select(*[c for c in facts.columns],
                        *[F.coalesce(F.col("__hot_" + c), F.col(c)).alias(c) for c in dim_cols],
                        F.coalesce(F.col(_HOT), F.lit(False)).alias(_HOT),
                        F.col(dim_cols[0]).isNotNull().alias("__cold_hit"))
    if how == "inner":
        out = out.filter(F.col(_HOT) | F.col("__cold_hit"))
    return out.drop(_HOT, "__cold_hit")
