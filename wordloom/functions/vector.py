"""Vector and sampling Column expressions (E1, E4, E5, W6, seeded uniform).

Arithmetic is done in DOUBLE even for FLOAT arrays.  These are higher-order
functions, fine for per-row work on moderate vectors; large all-pairs work
goes through the blocked Arrow path in ``operators.similarity``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def to_double_array(vec) -> Column:
    return F.transform(_col(vec), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Dot product; the shorter vector is padded with zeros."""
    prods = F.zip_with(_col(a), _col(b),
                       lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) *
                       F.coalesce(y.cast("double"), F.lit(0.0)))
    return _sum(prods)


def squared_norm(a) -> Column:
    return _sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")))


def cosine_similarity(a, b) -> Column:
    """Dot / (|a| * |b|), zero-padded; a zero vector gives null (not NaN)."""
    denom = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return dot(a, b) / F.nullif(denom, F.lit(0.0))


def position_encoding(vec, position, period: int = 5000) -> Column:
    """``x[k] + sin(2*pi*position/period/k)`` for k = 1..len.

    Unchanged when position or period is 0.
    """
    v = to_double_array(vec)
    p = _col(position) if not isinstance(position, int) else F.lit(position)
    if period == 0:
        return v
    arg = F.lit(2.0 * math.pi) * p.cast("double") / F.lit(float(period))
    encoded = F.transform(v, lambda x, i: x + F.sin(arg / (i + 1).cast("double")))
    return F.when(p == 0, v).otherwise(encoded)


def squared_error(pred, target) -> Column:
    """E5: sum over elements of (pred - target)^2 (zero-padded)."""
    diffs = F.zip_with(_col(pred), _col(target),
                       lambda x, y: F.pow(F.coalesce(x.cast("double"), F.lit(0.0)) -
                                          F.coalesce(y.cast("double"), F.lit(0.0)), 2))
    return _sum(diffs)


def keep_probability(frequency, subsample: float = 1e-3) -> Column:
    """clamp(sqrt(f/s + 1) * s/f, 0, 1)."""
    f = _col(frequency).cast("double")
    s = F.lit(float(subsample))
    raw = F.sqrt(f / s + F.lit(1.0)) * (s / f)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def seeded_uniform(seed, *keys) -> Column:
    """Deterministic uniform in [0, 1) from (seed, keys...).

    First 32 bits of md5 of ``seed|k1|k2...`` divided by 2^32; independent of
    partitioning and reproducible in plain SQL.
    """
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)
