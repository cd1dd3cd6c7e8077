"""Document store on Parquet (S1, S3-S6) and document builders.

A document table has the D1 schema ``(doc_id, input, context, output)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import dense_ids


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def build_documents(df: DataFrame, doc_id="doc_id", output=None, input=None,
                    context=None, lowercase: bool = False) -> DataFrame:
    """Project any table to D1; absent or null texts become ''."""
    cols = {
        "input": _text(input) if input is not None else F.lit(""),
        "context": _text(context) if context is not None else F.lit(""),
        "output": _text(output) if output is not None else F.lit(""),
    }
    if lowercase:
        cols = {k: F.lower(v) for k, v in cols.items()}
    id_col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(id_col.cast("long").alias("doc_id"),
                     cols["input"].alias("input"),
                     cols["context"].alias("context"),
                     cols["output"].alias("output"))


def with_input(docs: DataFrame, value) -> DataFrame:
    return docs.withColumn("input", _text(value))


def with_context(docs: DataFrame, value) -> DataFrame:
    return docs.withColumn("context", _text(value))


def with_output(docs: DataFrame, value) -> DataFrame:
    return docs.withColumn("output", _text(value))


def read_text_documents(spark: SparkSession, path: str, lowercase: bool = False,
                        start_id: int = 1) -> DataFrame:
    """Every file under ``path`` becomes one document body.

    Ids follow the file path order, starting at ``start_id``.
    """
    raw = (spark.read.text(path, wholetext=True)
                .select(F.col("value").alias("output"), F.input_file_name().alias("path")))
    docs = dense_ids(raw, ["path"], id_col="doc_id", start=start_id)
    return build_documents(docs, output="output", lowercase=lowercase)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Scan a document table (unordered; sort only if the caller needs it)."""
    return spark.read.parquet(path)


def append_documents(store: DataFrame, new_docs: DataFrame, order_cols: list) -> DataFrame:
    """S3: give ``new_docs`` ids after the store's largest id, in ``order_cols`` order.

    Returns the appended rows only (D1); write them with ``mode("append")``.
    The current maximum is a one-row aggregate; ids come from the scalable
    dense-id operator, not a one-partition window.
    """
    start = store.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first()["m"] + 1
    with_ids = dense_ids(new_docs.drop("doc_id") if "doc_id" in new_docs.columns else new_docs,
                         order_cols, id_col="doc_id", start=int(start))
    return with_ids.select("doc_id", "input", "context", "output")


def write_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    docs.select("doc_id", "input", "context", "output").write.mode(mode).parquet(path)


def lookup_documents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """S5 (batch form): ``ids(doc_id)`` left-joined to the store; absent -> nulls."""
    return ids.select(F.col("doc_id").cast("long")).join(store, "doc_id", "left")


def lookup_document(store: DataFrame, doc_id: int) -> DataFrame:
    """S5 (point form): a filter that Parquet pushes down to the scan."""
    return store.filter(F.col("doc_id") == F.lit(doc_id).cast("long"))


def count_documents(store: DataFrame) -> DataFrame:
    """The true number of documents (one row)."""
    return store.agg(F.count(F.lit(1)).alias("n_documents"))
