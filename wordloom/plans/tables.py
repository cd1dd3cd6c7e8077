"""Mapping of the shared test tables onto the engine's data model.

* documents     -> D1 corpus: doc_id, input '', context = source, output = text
* conversations -> chat messages: chat = conv_id, author = role, content = text
* embeddings    -> token vectors: token = vec_id as text
* vocabulary tokens get a stand-in vector: tokens seen at least twice take the
  embedding row ``vec_id = token_id mod n`` (what a fitted model would provide)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vocab import build_vocabulary, token_arrays as arrays_of, token_occurrences
from ..sources.chat import messages_from_table
from ..sources.documents import build_documents

# Fixed parameters of the registered queries (reference defaults).
CONTEXT_RADIUS = 3
MIN_OCCURRENCES = 2
SUBSAMPLE = 1e-3
CONTEXT_TOKENS = 16
PERIOD = 5000
TOP_N = 10
SEED = 42
LAST_N = 3
SKETCH_DIMS = 16
SHORT_CONTEXT, SHORT_DIMS = 2, 4
SERVER = "corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_documents(table(spark, sf_dir, "documents"), output="text", context="source")


def occurrences(spark: SparkSession, sf_dir: str, **opts) -> DataFrame:
    return token_occurrences(corpus(spark, sf_dir), **opts)


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays_of(corpus(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_vocabulary(token_arrays(spark, sf_dir))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return messages_from_table(conv, server=F.lit(SERVER),
                               channel=F.concat(F.lit("chat"), F.col("conv_id").cast("string")))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(token, embedding)`` straight from the embeddings table."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("token"), "embedding", "vec_id", "label")


def token_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    """Stand-in vectors for vocabulary tokens: ``(token_id, token, occurrences, embedding)``."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()
    keyed = (vocab.filter(F.col("occurrences") >= MIN_OCCURRENCES)
                  .select("token_id", "token", "occurrences", F.pmod(F.col("token_id"), n).alias("vec_id")))
    return keyed.join(emb.select("vec_id", "embedding"), "vec_id").drop("vec_id")
