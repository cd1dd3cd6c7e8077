"""Token-vector store.

A vector table is ``(token STRING, embedding ARRAY<FLOAT>)`` on Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Scan a vector table."""
    return spark.read.parquet(path)


def upsert_vectors(store: DataFrame, updates: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Insert-or-replace by token.

    Duplicate tokens inside ``updates`` are reduced first: the row with the
    largest ``seq_col`` wins (the last write).  Without ``seq_col`` the
    updates must be unique per token.
    """
    if seq_col is not None:
        updates = (updates.groupBy("token")
                          .agg(F.max_by("embedding", seq_col).alias("embedding")))
    new = updates.select("token", F.col("embedding").cast("array<float>").alias("embedding"))
    kept = store.select("token", "embedding").join(new.select("token"), "token", "left_anti")
    return kept.unionByName(new)


# A token is exported when its first character is alphanumeric
# or ASCII punctuation other than the double quote and the backslash.
EXPORT_FIRST_CHAR = r"^[\p{IsAlphabetic}\p{N}!#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]"


def export_rows(vectors: DataFrame) -> DataFrame:
    """S10 (rows): exported tokens with one column per vector element.

    Columns: ``token, embedding1 .. embeddingN`` (N: the longest vector).
    """
    kept = vectors.filter(F.col("token").rlike(EXPORT_FIRST_CHAR))
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    return kept.select("token", *[F.get(F.col("embedding"), i).alias(f"embedding{i + 1}")
                                  for i in range(width)])


def export_csv(vectors: DataFrame, path: str) -> int:
    """Write the export as CSV (header, every value quoted); returns rows written."""
    rows = export_rows(vectors)
    out = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return out.count()
