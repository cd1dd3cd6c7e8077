import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import samples as sm


def _arrays(spark, docs):
    return spark.createDataFrame([(i, ids) for i, ids in enumerate(docs)], "doc_id long, ids array<long>")


def test_symmetric_window_counts_and_content(spark):
    docs = [list(range(1, 11)), [1, 2, 3], list(range(1, 8)), []]
    w = sm.symmetric_windows(_arrays(spark, docs), radius=3).collect()
    assert len(w) == sum(max(0, len(d) - 6) for d in docs)
    first = [r for r in w if r.doc_id == 0 and r.pos == 3][0]
    assert (first.target_id, first.left, first.right) == (4, [1, 2, 3], [5, 6, 7])


def test_dynamic_radius_in_range(spark):
    w = sm.symmetric_windows(_arrays(spark, [list(range(1, 200))]), 3, dynamic=True).collect()
    radii = {len(r.left) for r in w}
    assert radii <= {1, 2, 3} and len(radii) == 3
    assert all(len(r.left) == len(r.right) for r in w)


def test_pairs_and_multi_hot(spark):
    w = sm.symmetric_windows(_arrays(spark, [[5, 5, 2, 9, 40000, 2, 7]]), radius=3)
    c = sm.cbow_pairs(w, cap=32768).first()
    assert c.inputs == [2, 5, 7] and c.outputs == [9]
    s = sm.skipgram_pairs(w, cap=32768).first()
    assert s.inputs == [9] and s.outputs == [2, 5, 7]


def test_causal_windows(spark):
    w = sm.causal_windows(_arrays(spark, [[3, 4, 5, 6, 7]]), context_tokens=3).orderBy("pos").collect()
    assert len(w) == 5
    assert w[0].context_ids == [0, 0, 0] and w[1].context_ids == [0, 0, 3]
    assert w[4].context_ids == [4, 5, 6] and w[4].target_id == 7


def test_split_sizes(spark):
    s = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"))
    out = sm.train_validation_split(s, seed=3)
    assert out.filter("validation").count() == 150 and out.count() == 1000
    assert sm.train_validation_split(s, seed=3, holdout=True).count() == 850


def test_split_is_the_first_k_of_the_shuffle(spark):
    s = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("pos"))
    shuffled = [(r.doc_id, r.pos) for r in s.orderBy(sm.seeded_uniform(5, F.lit("validation"), "doc_id", "pos"), "doc_id", "pos").collect()]
    for share, cap in ((0.15, 10000), (0.5, 7), (1.0, 10000), (0.0, 5), (0.0004, 5)):
        k = min(int(3000 * share), cap)
        got = {(r.doc_id, r.pos) for r in sm.train_validation_split(s, seed=5, share=share, cap=cap).filter("validation").collect()}
        assert got == set(shuffled[:k])
    empty = sm.train_validation_split(s.limit(0), seed=5)
    assert empty.count() == 0 and empty.columns == ["doc_id", "pos", "validation"]


def test_split_finds_the_edge_inside_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(sm, "KEY_BUCKETS", 1)
    s = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"))
    out = sm.train_validation_split(s, seed=3)
    first = s.orderBy(sm.seeded_uniform(3, F.lit("validation"), "doc_id", "pos")).limit(150).collect()
    assert {r.pos for r in out.filter("validation").collect()} == {r.pos for r in first}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_window_features_numpy():
    mat = np.arange(12, dtype=float).reshape(6, 2)
    has = np.array([False, True, True, True, False, True])
    ids = np.array([1, 2, 3, 4, 5])
    pos, tgt, X, Y = sm.window_features(ids, mat, has, 2, 0)
    # target 4 has no vector; samples whose context holds 4 are dropped
    assert list(tgt) == [1, 2, 3]
    assert X.shape == (3, 4) and list(X[0]) == [0, 0, 0, 0]
    assert list(X[2]) == list(mat[1]) + list(mat[2])


def test_next_token_features_table(spark):
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "token_id long, embedding array<float>")
    f = sm.next_token_features(_arrays(spark, [[1, 2, 3, 4, 5]]), vecs, context_tokens=2, period=5000).collect()
    assert len(f) == 5 and all(len(r.features) == 4 for r in f)


def test_partition_invariance(spark):
    docs = [list(np.random.default_rng(i).integers(1, 50, 30)) for i in range(20)]
    a = _arrays(spark, [[int(x) for x in d] for d in docs])
    one = sm.symmetric_windows(a.repartition(1), 3, dynamic=True).collect()
    seven = sm.symmetric_windows(a.repartition(7), 3, dynamic=True).collect()
    assert sorted(map(str, one)) == sorted(map(str, seven))


def test_join_form_equals_broadcast_form(spark):
    rng = np.random.default_rng(5)
    vecs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 9) if i != 6],
                                 "token_id long, embedding array<float>")
    docs = [[int(x) for x in rng.integers(1, 9, n)] for n in (1, 4, 9, 15)]
    a = _arrays(spark, docs)
    for align in (False, True):
        bc = sm.next_token_features(a, vecs, 3, 40, align_positions=align).collect()
        jn = sm.next_token_features(a, vecs, 3, 40, align_positions=align, max_broadcast_rows=2).collect()
        key = lambda r: (r.doc_id, r.pos)
        assert [key(r) for r in sorted(bc, key=key)] == [key(r) for r in sorted(jn, key=key)]
        for x, y in zip(sorted(bc, key=key), sorted(jn, key=key)):
            assert np.allclose(x.features, y.features) and np.allclose(x.target, y.target)


def test_shuffle_order_is_seeded_and_partition_free(spark):
    s = spark.range(200).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"))
    a = [r.pos for r in sm.shuffle_order(s.repartition(1), seed=9).orderBy("shuffle_key").collect()]
    b = [r.pos for r in sm.shuffle_order(s.repartition(5), seed=9).orderBy("shuffle_key").collect()]
    c = [r.pos for r in sm.shuffle_order(s, seed=10).orderBy("shuffle_key").collect()]
    assert a == b and a != c and sorted(a) == list(range(200))


def test_window_blocks_equal_the_whole(spark):
    rng = np.random.default_rng(5)
    ids, mat, has = rng.integers(0, 9, 50), rng.normal(size=(8, 3)).astype(np.float32), np.array([False] + [True] * 7)
    for align in (False, True):
        whole = sm.window_features(ids, mat, has, 4, 50, align)
        parts = list(zip(*sm.window_blocks(ids, mat, has, 4, 50, align, rows=7)))
        assert all(np.allclose(np.concatenate(p), w) for p, w in zip(parts, whole))


def test_multi_hot_width_counts_what_it_leaves_out(spark):
    w = sm.symmetric_windows(_arrays(spark, [[5, 5, 2, 9, 40000, 2, 7]]), radius=3)
    assert sm.cbow_pairs(w).first().inputs == [2, 5, 7, 40000]
    assert sm.cbow_pairs(w, cap=32768).first().n_beyond == 1
    assert sm.skipgram_pairs(w, cap=9).first().n_beyond == 2
