"""Registered queries: every operator run over the whole test tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``plans.oracle``.  Arrays are flattened to
strings or summarized, doubles that depend on summation order are rounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import arrays as ar
from ..operators import cooccurrence as co
from ..operators import pivots as pv
from ..operators import samples as sm
from ..operators import similarity as sim
from ..operators import vocab as vc
from ..session import materialize
from ..sources import chat as ch
from ..sources import documents as dc
from ..sources import vectors as vs
from . import tables as tb


def _ids_text(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


# ---- documents (S1, S3, S5, S6, P1, P2) ----

def documents_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return dc.build_documents(tb.table(spark, sf, "documents"), output="text")


def documents_lowercase(spark, sf):
    return dc.build_documents(tb.table(spark, sf, "documents"), output="text", context="source",
                              lowercase=True)


def documents_patch(spark, sf):
    """A document table whose input and context are replaced."""
    docs = tb.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    built = dc.build_documents(docs, output="text").join(docs.select("doc_id", "lang", "source"), "doc_id")
    return dc.with_context(dc.with_input(built, "lang"), "source").select("doc_id", "input", "context", "output")


def document_lookup(spark, sf):
    ids = tb.table(spark, sf, "labels").select("doc_id")
    return dc.lookup_documents(tb.corpus(spark, sf), ids)


def document_count(spark, sf):
    return dc.count_documents(tb.corpus(spark, sf))


def documents_append(spark, sf):
    new = ch.merge_documents(tb.chat_messages(spark, sf))
    return dc.append_documents(tb.corpus(spark, sf), new, ["chat_id"])


# ---- chats (P3-P6) ----

def chat_last_n(spark, sf):
    return ch.last_messages(tb.chat_messages(spark, sf), tb.LAST_N).select(
        "chat_id", "turn", "author", "content")


def chat_split(spark, sf):
    return ch.split_documents(tb.chat_messages(spark, sf))


def chat_merge(spark, sf):
    return ch.merge_documents(tb.chat_messages(spark, sf))


def chat_parse(spark, sf):
    """Exports of all conversations as JSON text, each seventh cut off at its end; messages and failures."""
    conv = tb.table(spark, sf, "conversations")
    message = F.struct(F.struct(F.col("role").alias("name")).alias("author"), F.col("text").alias("content"))
    exports = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("s"))
    whole = F.to_json(F.struct(F.struct(F.lit(tb.SERVER).alias("name")).alias("guild"),
                               F.struct(F.concat(F.lit("chat"), F.col("conv_id").cast("string")).alias("name")).alias("channel"),
                               F.transform("s", lambda x: x["m"]).alias("messages")))
    files = exports.select("conv_id", whole.alias("w")).select(
        "conv_id", F.col("conv_id").cast("string").alias("path"),
        F.when(F.col("conv_id") % 7 == 0, F.expr("left(w, length(w) - 2)")).otherwise(F.col("w")).alias("value"))
    messages, failures = ch.parse_chat_exports(files, chat_id="conv_id")
    return messages.select("chat_id", "turn", "server", "channel", "author", "content", F.lit(None).cast("string").alias("failure")).unionByName(
        failures.select(F.col("path").cast("long").alias("chat_id"), F.col("reason").alias("failure")), allowMissingColumns=True)


# ---- tokenizer (T1-T5) ----

def normalize_text(spark, sf):
    d = tb.table(spark, sf, "documents")
    return d.select("doc_id", tx.normalize("text", lowercase=True, strip_punctuation=True).alias("text"))


def tokenize_text(spark, sf):
    d = tb.table(spark, sf, "documents")
    return (d.select("doc_id", F.posexplode(tx.tokenize("text")).alias("pos", "token"))
             .withColumn("pos", F.col("pos").cast("long")))


def tokenize_keep_ws(spark, sf):
    p = tb.table(spark, sf, "pages")
    return (p.select(F.col("page_id").alias("doc_id"),
                     F.posexplode(tx.tokenize("html", keep_whitespace=True)).alias("pos", "token"))
             .withColumn("pos", F.col("pos").cast("long")))


def tokenize_document(spark, sf):
    return tb.occurrences(spark, sf, lowercase=True, strip_punctuation=True)


def _pages_corpus(spark, sf):
    return dc.build_documents(tb.table(spark, sf, "pages"), doc_id="page_id", input="url",
                              output="html")


def detokenize(spark, sf):
    docs = _pages_corpus(spark, sf)
    back = docs.select("doc_id", tx.detokenize(tx.tokenize_document(keep_whitespace=True)).alias("d"))
    return back.select("doc_id", "d.input", "d.context", "d.output")


# ---- vocabulary (V1-V5) and lookups (J1-J5) ----

def vocabulary_counts(spark, sf):
    return vc.vocabulary_counts(tb.occurrences(spark, sf))


def vocabulary_ids(spark, sf):
    return tb.vocabulary(spark, sf)


def distinct_tokens(spark, sf):
    return vc.distinct_token_count(tb.occurrences(spark, sf))


def vocabulary_merge(spark, sf):
    delta_docs = ch.merge_documents(tb.chat_messages(spark, sf)).withColumnRenamed("chat_id", "doc_id")
    return vc.merge_vocabulary(tb.vocabulary(spark, sf), vc.token_occurrences(delta_docs))


def _benchmark_occ(spark, sf):
    docs = dc.build_documents(tb.table(spark, sf, "benchmark"), doc_id="item_id", output="text")
    return vc.token_occurrences(docs)


def encode_extend(spark, sf):
    return vc.extend_vocabulary(tb.vocabulary(spark, sf), _benchmark_occ(spark, sf))


def encode_documents(spark, sf):
    return ar.as_rows(vc.encode_tokens(tb.token_arrays(spark, sf), tb.vocabulary(spark, sf)))


def decode_ids(spark, sf):
    vocab = tb.vocabulary(spark, sf)
    ids = ar.as_rows(vc.encode_tokens(tb.token_arrays(spark, sf), vocab))
    return vc.decode_ids(ids, vocab)


def _weighted(c):
    """Elements times their places, added up: tells swapped elements apart."""
    products = F.transform(vx.to_double_array(c), lambda x, i: x * (i + 1))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def attach_embeddings(spark, sf):
    tv = tb.token_vectors(spark, sf)
    occ = _benchmark_occ(spark, sf)
    joined = sim.attach_vectors(occ, tv)
    return joined.select(
        F.col("doc_id").alias("item_id"), "pos", "token",
        F.col("embedding").isNotNull().alias("has_vector"),
        F.round(F.aggregate(vx.to_double_array("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"),
        F.round(_weighted("embedding"), 4).alias("vector_weighted"))


def _prompt_docs(spark, sf):
    conv = tb.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return conv.select("conv_id", "turn", F.trim("text").alias("input"))


def prompt_tokens(spark, sf):
    from ..operators.models import prompt_token_array
    p = _prompt_docs(spark, sf)
    return (p.select("conv_id", "turn", F.posexplode(prompt_token_array("input")).alias("pos", "token"))
             .withColumn("pos", F.col("pos").cast("long")))


def prompt_index(spark, sf):
    from ..operators.models import index_prompts
    p = _prompt_docs(spark, sf)
    return index_prompts(p, tb.token_vectors(spark, sf), ["conv_id", "turn"]).select(
        "conv_id", "turn", "n_tokens", "n_missing", "accepted")


# ---- training samples (W1-W13, P7) ----

def _encoded(spark, sf, with_keep=False, vocab=None):
    enc = sm.encode_with_stats(tb.token_arrays(spark, sf), tb.vocabulary(spark, sf) if vocab is None else vocab, stats=with_keep)
    return sm.with_sampling_flag(enc, tb.MIN_OCCURRENCES, tb.SUBSAMPLE, tb.SEED) if with_keep else enc


def _around(spark, sf, with_keep=False):
    """Chunks that hold every context of CONTEXT_RADIUS ids to both sides."""
    return sm.id_chunks(_encoded(spark, sf, with_keep), tb.CONTEXT_RADIUS, tb.CONTEXT_RADIUS, with_keep)


def context_windows(spark, sf):
    w = sm.symmetric_windows(_around(spark, sf), tb.CONTEXT_RADIUS)
    return w.select("doc_id", "pos", "target_id", _ids_text(F.concat("left", "right")).alias("context"))


def context_windows_dynamic(spark, sf):
    w = sm.symmetric_windows(_around(spark, sf), tb.CONTEXT_RADIUS, dynamic=True, seed=tb.SEED)
    return w.select("doc_id", "pos", "target_id", _ids_text(F.concat("left", "right")).alias("context"))


def cbow_pairs(spark, sf):
    w = sm.symmetric_windows(_around(spark, sf), tb.CONTEXT_RADIUS)
    p = sm.cbow_pairs(w)
    return p.select("doc_id", "pos", _ids_text("inputs").alias("inputs"), _ids_text("outputs").alias("outputs"))


def skipgram_pairs(spark, sf):
    w = sm.symmetric_windows(_around(spark, sf), tb.CONTEXT_RADIUS)
    p = sm.skipgram_pairs(w)
    return p.select("doc_id", "pos", _ids_text("inputs").alias("inputs"), _ids_text("outputs").alias("outputs"))


def multi_hot(spark, sf):
    a = sm.id_arrays(_encoded(spark, sf))
    idx = sm.multi_hot("ids")
    return a.select("doc_id", F.size(idx).cast("long").alias("n_indices"), _ids_text(idx).alias("indices"))


def keep_probability(spark, sf):
    v = tb.vocabulary(spark, sf)
    return v.select("token", "frequency", vx.keep_probability("frequency", tb.SUBSAMPLE).alias("keep_probability"))


def sample_targets(spark, sf):
    w = sm.symmetric_windows(_around(spark, sf, with_keep=True), tb.CONTEXT_RADIUS, only_kept=True)
    return w.select("doc_id", "pos", "target_id")


def train_validation_split(spark, sf):
    """W13 on the sampled targets; the stored chunks of ids are read by both passes."""
    arrays = materialize(_around(spark, sf, with_keep=True))
    s = sm.symmetric_windows(arrays, tb.CONTEXT_RADIUS, only_kept=True).select("doc_id", "pos", "target_id")
    return sm.train_validation_split(s, seed=tb.SEED).select("doc_id", "pos", "target_id", "validation")


def shuffle_order(spark, sf):
    """The sort key of the seeded shuffle of all samples."""
    return sm.shuffle_order(sample_targets(spark, sf), tb.SEED).select("doc_id", "pos", "target_id", "shuffle_key")


def causal_windows(spark, sf):
    w = sm.causal_windows(sm.id_chunks(_encoded(spark, sf), tb.CONTEXT_TOKENS), tb.CONTEXT_TOKENS)
    return w.select("doc_id", "pos", "target_id", _ids_text("context_ids").alias("context"))


def _checksums(*blocks):
    """Of each block the rows' plain sums, and sums weighted by place, which tell swapped slots and elements apart."""
    return [c for m in blocks for c in (m.sum(axis=1), m @ np.arange(1.0, m.shape[1] + 1))]


def _feature_checksums(X, Y):
    return [np.full(len(X), X.shape[1]), *_checksums(X, Y)]


_CHECKSUMS = T.StructType([T.StructField("n_features", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (
    "feature_sum", "feature_weighted", "target_sum", "target_weighted")]])


def next_token_features(spark, sf):
    vocab = tb.vocabulary(spark, sf)
    arrays = sm.id_chunks(vc.encode_tokens(tb.token_arrays(spark, sf), vocab), tb.CONTEXT_TOKENS)
    # The checksums are taken where the features are, which are 8 KB a sample.
    f = sm.next_token_features(arrays, materialize(tb.token_vectors(spark, sf, vocab)), tb.CONTEXT_TOKENS, tb.PERIOD,
                               summary=(_feature_checksums, _CHECKSUMS))
    return f.select("doc_id", "pos", "target_id", "n_features",
                    F.round("feature_sum", 6).alias("feature_sum"), F.round("feature_weighted", 3).alias("feature_weighted"),
                    F.round("target_sum", 6).alias("target_sum"), F.round("target_weighted", 3).alias("target_weighted"))


# ---- embeddings from samples (L1, L2) ----

def _sketch(spark, sf, vocab):
    chunks = sm.id_chunks(_encoded(spark, sf, True, vocab), tb.CONTEXT_RADIUS, tb.CONTEXT_RADIUS, with_keep=True)
    samples = sm.embedding_samples(chunks, tb.CONTEXT_RADIUS, dynamic=True, method="cbow", seed=tb.SEED)
    return co.cooccurrence_sketch(samples, tb.SKETCH_DIMS, tb.SEED)


def _sums(sketch):
    return [F.col("sums")[k].alias(f"d{k + 1}") for k in range(tb.SKETCH_DIMS)]


def fit_cooccurrence(spark, sf):
    """L1: the sums behind the embeddings of every sampled context token."""
    sketch = _sketch(spark, sf, tb.vocabulary(spark, sf))
    return sketch.select("token_id", "n_pairs", *_sums(sketch))


def embed_all_tokens(spark, sf):
    """L2: sums and source of every vocabulary token's vector."""
    vocab = tb.vocabulary(spark, sf)
    rows = co.embed_all_tokens(vocab, materialize(_sketch(spark, sf, vocab)), seed=tb.SEED)
    norm = F.aggregate(rows["embedding"], F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("token_id", "token", "source", *_sums(rows), F.round(norm, 3).alias("squared_length"))


# ---- sums and losses of the next-token model (L3, L4), for vectors short enough to compare each number ----

def _short_model(spark, sf):
    vocab = tb.vocabulary(spark, sf)
    chunks = sm.id_chunks(vc.encode_tokens(tb.token_arrays(spark, sf), vocab), tb.SHORT_CONTEXT)
    vectors = tb.token_vectors(spark, sf, vocab).withColumn("embedding", F.slice("embedding", 1, tb.SHORT_DIMS))
    return chunks, materialize(vectors)


def next_token_gram(spark, sf):
    """L3: every number of X'X, X'1 and X'Y over all samples."""
    from ..operators import models as md
    gram = md.next_token_gram(*_short_model(spark, sf), tb.SHORT_CONTEXT, tb.PERIOD)
    entries = md.gram_entries(gram, tb.SHORT_CONTEXT * tb.SHORT_DIMS + 1, tb.SHORT_DIMS)
    return entries.select("i", "j", F.round("value", 3).alias("value"))


def validate_next_token_total(spark, sf):
    """L4: the total loss of the model that foretells the last context token, over all samples."""
    from ..operators import models as md
    C, d = tb.SHORT_CONTEXT, tb.SHORT_DIMS
    weights = spark.createDataFrame([(i, [float(i == (C - 1) * d + k) for k in range(d)]) for i in range(C * d + 1)],
                                    "row long, weights array<double>")
    scored = md.score_next_token(*_short_model(spark, sf), weights, C, tb.PERIOD)
    return md.total_loss(scored).select("n_samples", F.round("loss", 3).alias("loss"))


# ---- vectors (E1-E5, S9, S10) ----

def _centroids(spark, sf):
    emb = tb.table(spark, sf, "embeddings")
    parts = emb.select("label", F.posexplode("embedding").alias("k", "x"))
    agg = parts.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (agg.groupBy("label")
               .agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
               .select("label", F.transform("s", lambda e: e["x"]).alias("centroid")))


def cosine_pairs(spark, sf):
    emb = tb.table(spark, sf, "embeddings")
    j = emb.join(_centroids(spark, sf), "label")
    return j.select("vec_id", "label",
                    F.round(vx.cosine_similarity("embedding", "centroid"), 6).alias("cosine"))


def squared_error(spark, sf):
    emb = tb.table(spark, sf, "embeddings")
    j = emb.join(_centroids(spark, sf), "label")
    per = j.select("label", vx.squared_error("embedding", "centroid").alias("se"))
    return per.groupBy("label").agg(F.round(F.sum("se"), 6).alias("sse"))


def similar_topn(spark, sf):
    v = tb.vector_table(spark, sf)
    r = sim.similar_tokens(v.select(F.col("token").alias("query"), "embedding"),
                           v.select("token", "embedding"), tb.TOP_N)
    return r.select("query", "token", F.round("similarity", 6).alias("similarity"), "rank")


def nearest_token(spark, sf):
    c = _centroids(spark, sf).select(F.col("label").cast("string").alias("query"),
                                     F.col("centroid").alias("embedding"))
    v = tb.vector_table(spark, sf).select("token", "embedding")
    r = sim.nearest_tokens(c, v)
    return r.select("query", "token", F.round("similarity", 6).alias("similarity"))


def _pivot_index(spark, sf):
    return pv.build_pivot_index(tb.vector_table(spark, sf).select("token", "embedding"))


def similar_topn_indexed(spark, sf):
    """E2 through the pivot index; the rows of similar_topn."""
    v = tb.vector_table(spark, sf).select(F.col("token").alias("query"), "embedding")
    r, _ = pv.search_pivot_index(_pivot_index(spark, sf), v, tb.TOP_N)
    return r.select("query", "token", F.round("similarity", 6).alias("similarity"), "rank")


def nearest_token_indexed(spark, sf):
    """E3 through the pivot index; the rows of nearest_token."""
    c = _centroids(spark, sf).select(F.col("label").cast("string").alias("query"), F.col("centroid").alias("embedding"))
    r, _ = pv.search_pivot_index(_pivot_index(spark, sf), c, 1)
    return r.select("query", "token", F.round("similarity", 6).alias("similarity"))


def compare_by_token(spark, sf):
    """E2 by token: document ids as tokens, of which some have a vector."""
    asked = tb.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("query"))
    r = sim.compare_tokens(asked, tb.vector_table(spark, sf).select("token", "embedding"), tb.TOP_N)
    return r.select("query", "indexed", "token", F.round("similarity", 6).alias("similarity"), "rank")


def position_encoding(spark, sf):
    emb = tb.table(spark, sf, "embeddings")
    enc = emb.select("vec_id", vx.position_encoding("embedding", F.col("vec_id"), tb.PERIOD).alias("v"))
    return (enc.select("vec_id", F.posexplode("v").alias("k", "value"))
               .select("vec_id", (F.col("k") + 1).cast("long").alias("k"), F.round("value", 6).alias("value")))


def embedding_upsert(spark, sf):
    store = tb.vector_table(spark, sf).select("token", "embedding")
    updates = _centroids(spark, sf).select(F.col("label").cast("string").alias("token"),
                                           F.col("centroid").alias("embedding"))
    out = vs.upsert_vectors(store, updates)
    return out.select("token", F.size("embedding").cast("long").alias("n"),
                      F.round(F.aggregate(vx.to_double_array("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"),
                      F.round(_weighted("embedding"), 4).alias("vector_weighted"))


def embedding_export_rows(spark, sf):
    tv = tb.token_vectors(spark, sf).select("token", "embedding")
    rows = vs.export_rows(tv)
    return rows.select("token", *[F.col(c).cast("double").alias(c) for c in rows.columns if c != "token"])


QUERIES = {
    "documents_from_text": documents_from_text,
    "documents_lowercase": documents_lowercase,
    "documents_patch": documents_patch,
    "document_lookup": document_lookup,
    "document_count": document_count,
    "documents_append": documents_append,
    "chat_last_n": chat_last_n,
    "chat_split": chat_split,
    "chat_merge": chat_merge,
    "chat_parse": chat_parse,
    "normalize_text": normalize_text,
    "tokenize_text": tokenize_text,
    "tokenize_keep_ws": tokenize_keep_ws,
    "tokenize_document": tokenize_document,
    "detokenize": detokenize,
    "vocabulary_counts": vocabulary_counts,
    "vocabulary_ids": vocabulary_ids,
    "distinct_tokens": distinct_tokens,
    "vocabulary_merge": vocabulary_merge,
    "encode_extend": encode_extend,
    "encode_documents": encode_documents,
    "decode_ids": decode_ids,
    "attach_embeddings": attach_embeddings,
    "prompt_tokens": prompt_tokens,
    "prompt_index": prompt_index,
    "context_windows": context_windows,
    "context_windows_dynamic": context_windows_dynamic,
    "cbow_pairs": cbow_pairs,
    "skipgram_pairs": skipgram_pairs,
    "multi_hot": multi_hot,
    "keep_probability": keep_probability,
    "sample_targets": sample_targets,
    "train_validation_split": train_validation_split,
    "shuffle_order": shuffle_order,
    "causal_windows": causal_windows,
    "next_token_features": next_token_features,
    "next_token_gram": next_token_gram,
    "validate_next_token_total": validate_next_token_total,
    "fit_cooccurrence": fit_cooccurrence,
    "embed_all_tokens": embed_all_tokens,
    "cosine_pairs": cosine_pairs,
    "squared_error": squared_error,
    "similar_topn": similar_topn,
    "nearest_token": nearest_token,
    "similar_topn_indexed": similar_topn_indexed,
    "nearest_token_indexed": nearest_token_indexed,
    "compare_by_token": compare_by_token,
    "position_encoding": position_encoding,
    "embedding_upsert": embedding_upsert,
    "embedding_export_rows": embedding_export_rows,
}
