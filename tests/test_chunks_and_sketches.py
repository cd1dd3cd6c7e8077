"""Windows over overlapping chunks, sums in two levels, and embeddings from co-occurrence sketches."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import cooccurrence as co
from wordloom.operators import models as md
from wordloom.operators import samples as sm


def encoded(spark, lengths, seed=0):
    rng = random.Random(seed)
    rows = [(d, p, rng.randint(1, 9), rng.random() < .6) for d, n in lengths.items() for p in range(n)]
    return spark.createDataFrame(rows, "doc_id long, pos long, token_id long, keep boolean")


LENGTHS = {1: 0, 2: 1, 3: 6, 4: 7, 5: 8, 6: 16, 7: 17, 8: 53, 9: 9, -4: 40}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("radius, chunk", [(1, 8), (3, 8), (3, 3), (2, 1000)])
@pytest.mark.parametrize("dynamic", [False, True])
def test_symmetric_windows_of_chunks_are_those_of_documents(spark, radius, chunk, dynamic):
    enc = encoded(spark, LENGTHS)
    whole = sm.symmetric_windows(sm.id_arrays(enc, with_keep=True), radius, dynamic)
    cut = sm.symmetric_windows(sm.id_chunks(enc, radius, radius, True, chunk), radius, dynamic)
    assert rows(cut) == rows(whole) != []


@pytest.mark.parametrize("context, chunk", [(1, 8), (4, 8), (8, 8), (16, 16), (4, 1000)])
def test_causal_windows_and_features_of_chunks_are_those_of_documents(spark, context, chunk):
    enc = encoded(spark, LENGTHS)
    vectors = spark.createDataFrame([(i, [float(i), i * .5, 1.0 - i]) for i in range(1, 9)], "token_id long, embedding array<float>")
    whole, cut = sm.id_arrays(enc), sm.id_chunks(enc, context, chunk=chunk)
    assert rows(sm.causal_windows(cut, context)) == rows(sm.causal_windows(whole, context)) != []
    for limit in (None, 0):
        for align in (False, True):
            a, b = (sm.next_token_features(x, vectors, context, 50, align, chunk=5, max_broadcast_rows=limit) for x in (cut, whole))
            assert rows(a) == rows(b) != []


def test_a_long_document_stays_in_bounded_groups(spark):
    n, chunk = 2_000_000, 4096
    enc = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 1000).alias("token_id"))
    chunks = sm.id_chunks(enc, 3, 3, chunk=chunk)
    sizes = chunks.agg(F.count("*"), F.max(F.size("ids"))).first()
    assert sizes[0] == -(-n // chunk) and sizes[1] == chunk + 6
    got = sm.symmetric_windows(chunks, 3).agg(F.count("*"), F.min("pos"), F.max("pos"), F.sum(F.col("left")[0]), F.sum(F.col("right")[2])).first()
    low, high = np.arange(0, n - 6) % 1000, np.arange(6, n) % 1000
    assert tuple(got) == (n - 6, 3, n - 4, low.sum(), high.sum())


def test_chunks_must_reach_their_neighbours_only(spark):
    with pytest.raises(ValueError):
        sm.id_chunks(encoded(spark, {1: 3}), 9, 0, chunk=8)
    empty = encoded(spark, {1: 1}).filter("false")
    assert sm.symmetric_windows(sm.id_chunks(empty, 2, 2, True, 8), 2).collect() == []


def test_task_buckets_hold_no_more_than_the_root():
    for tasks in (1, 2, 10, 100, 5000):
        sizes = Counter(md.task_bucket(t) for t in range(tasks))
        assert max(sizes.values()) <= int(tasks ** .5) + 1 and len(sizes) <= 2 * int(tasks ** .5) + 2


@pytest.mark.parametrize("limit", [None, 0])
def test_gram_entries_are_the_products_of_all_samples(spark, limit):
    enc = encoded(spark, {d: 40 for d in range(30)}).repartition(9)
    vectors = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=20).astype(float).tolist()) for i in range(1, 10)],
                                    "token_id long, embedding array<float>")
    chunks = sm.id_chunks(enc, 4, chunk=16)
    feats = sm.next_token_features(chunks, vectors, 4, 50).collect()
    Z = np.hstack([np.array([r.features for r in feats]), np.ones((len(feats), 1)), np.array([r.target for r in feats])])
    want = Z.T @ Z
    gram = md.next_token_gram(chunks, vectors, 4, 50, max_broadcast_rows=limit)
    assert {r.n for r in gram.collect()} == {len(feats)}
    got = md.gram_entries(gram, 81, 20).collect()
    assert {(r.i, r.j) for r in got} == {(i, j) for i in range(81) for j in range(i, 101)}
    assert all(abs(r.value - want[r.i, r.j]) < 1e-6 for r in got)


def test_total_loss_is_the_sum_of_all_samples(spark):
    scored = spark.createDataFrame([(1, 0, 2, 1.5), (1, 1, 3, 2.5)], "doc_id long, pos long, target_id long, loss double")
    assert tuple(md.total_loss(scored).first()) == (2, 4.0) and tuple(md.total_loss(scored.filter("false")).first()) == (0, 0.0)


# ---- co-occurrence ----

def signs(i, dims, seed):
    digits = "".join(hashlib.md5(f"{seed}|sign|{b}|{i}".encode()).hexdigest() for b in range(-(-dims // 32)))
    return np.array([1 if c >= "8" else -1 for c in digits[:dims]])


@pytest.mark.parametrize("method", ["cbow", "skipgram"])
@pytest.mark.parametrize("dims", [5, 40])
def test_sketch_adds_the_signs_of_all_neighbours(spark, method, dims):
    chunks = sm.id_chunks(encoded(spark, LENGTHS), 3, 3, True, 8)
    samples = sm.embedding_samples(chunks, 3, True, method)
    want, n = {}, Counter()
    for r in samples.collect():
        for i in r.inputs:
            for o in r.outputs:
                want[i] = want.get(i, 0) + signs(o, dims, 7)
                n[i] += 1
    got = co.cooccurrence_sketch(samples, dims, 7).collect()
    assert {r.token_id: (r.n_pairs, r.sums) for r in got} == {i: (n[i], v.tolist()) for i, v in want.items()}
    for r in co.fit_cooccurrence(samples, dims, 7).collect():
        v = want[r.token_id]
        if v.any():
            assert np.allclose(r.embedding, v / np.linalg.norm(v), atol=1e-6)
        else:
            assert r.embedding is None


def test_sketches_of_parts_merge_into_that_of_all(spark):
    samples = sm.embedding_samples(sm.id_chunks(encoded(spark, LENGTHS), 2, 2, True, 8), 2, False)
    parts = [co.cooccurrence_sketch(samples.filter(F.pmod("doc_id", F.lit(3)) == k), 6) for k in range(3)]
    assert rows(co.merge_sketches(*parts)) == rows(co.cooccurrence_sketch(samples, 6))
    assert co.merge_sketches(parts[0].filter("false")).collect() == []


def test_tokens_that_meet_like_neighbours_get_like_vectors(spark):
    rng = random.Random(1)
    rows_ = []
    for d in range(400):
        family = d % 2
        ids = [rng.choice([1, 2] if family else [3, 4]) if p % 2 else rng.randint(10 + 40 * family, 49 + 40 * family) for p in range(21)]
        rows_ += [(d, p, i, True) for p, i in enumerate(ids)]
    enc = spark.createDataFrame(rows_, "doc_id long, pos long, token_id long, keep boolean")
    samples = sm.embedding_samples(sm.id_chunks(enc, 1, 1, True), 1, False)
    v = {r.token_id: np.array(r.embedding) for r in co.fit_cooccurrence(samples, 128).collect()}
    assert v[1] @ v[2] > .9 and v[3] @ v[4] > .9 and abs(v[1] @ v[3]) < .5


def test_every_token_gets_a_vector_and_its_source(spark):
    vocab = spark.createDataFrame([(1, "walking"), (2, "walked"), (3, "walks"), (4, "zzzzz"), (5, "§"), (6, "talking")], "token_id long, token string")
    sketch = spark.createDataFrame([(1, 3, [4, -2]), (2, 1, [1, 1])], "token_id long, n_pairs long, sums array<long>")
    got = {r.token: r for r in co.embed_all_tokens(vocab, sketch, seed=7).collect()}
    assert {t: r.source for t, r in got.items()} == {"walking": "learned", "walked": "learned", "walks": "composed",
                                                    "zzzzz": "hashed", "§": "hashed", "talking": "composed"}
    # walks has \x02wa, wal, alk in common with both; talking shares alk and, with walking only, lki kin ing ng\x03
    assert got["walks"].sums == [15, -3] and got["talking"].sums == [4 * 5 + 1, -2 * 5 + 1]
    assert got["§"].sums == signs(5, 2, 7).tolist()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got.values())
