import glob
import math
import tempfile

import numpy as np
from pyspark.sql import functions as F

from wordloom.functions import vector as vx
from wordloom.operators import similarity as sim
from wordloom.sources import vectors as vs


def _vecs(spark, rows):
    return spark.createDataFrame(rows, "token string, embedding array<float>")


def test_store_read_back_and_nearest(spark):
    store = _vecs(spark, [("A", [1.0, 2.0, 3.0]), ("B", [1.0, 2.0, 4.0])])
    assert {r.token: list(r.embedding) for r in store.collect()} == {"A": [1, 2, 3], "B": [1, 2, 4]}
    q = spark.createDataFrame([("q1", [1.0, 2.0, 2.0]), ("q2", [1.0, 2.0, 5.0])], "query string, embedding array<double>")
    got = {r.query: r.token for r in sim.nearest_tokens(q, store).collect()}
    assert got == {"q1": "A", "q2": "B"}


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [r.c for r in df.select(vx.cosine_similarity("a", "b").alias("c")).collect()]
    assert got[0] is None and got[1] == 1.0 and got[2] == 0.0


def test_position_encoding_golden(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "v array<double>")
    got = df.select(vx.position_encoding("v", 1, 5000).alias("e")).first()["e"]
    assert [round(x, 6) for x in got] == [0.001257, 1.000628, 2.000419, 3.000314]
    assert df.select(vx.position_encoding("v", 0, 5000).alias("e")).first()["e"] == [0.0, 1.0, 2.0, 3.0]
    assert df.select(vx.position_encoding("v", 3, 0).alias("e")).first()["e"] == [0.0, 1.0, 2.0, 3.0]


def test_keep_probability_golden(spark):
    df = spark.createDataFrame([(f,) for f in [1e-6, 1e-3, 0.0017, 0.05, 0.5]], "f double")
    got = [r.k for r in df.select(vx.keep_probability("f", 1e-3).alias("k")).collect()]
    # sqrt(2.7) / 1.7 = 0.96656921912676...
    # for the third one, from the formula.
    want = [1.0, 1.0, 0.9665692191267639, 0.14282856857085702, 0.04476605857119879]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want))


def test_squared_error_and_uniform(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0, 1.0])], "p array<double>, t array<double>")
    assert df.select(vx.squared_error("p", "t").alias("e")).first()["e"] == 6.0
    u = spark.range(1000).select(vx.seeded_uniform(7, "id").alias("u"))
    vals = [r.u for r in u.collect()]
    assert all(0 <= x < 1 for x in vals) and 0.4 < sum(vals) / len(vals) < 0.6


def test_upsert_last_write_wins(spark):
    store = _vecs(spark, [("a", [1.0]), ("b", [2.0])])
    upd = spark.createDataFrame([("b", [5.0], 1), ("b", [6.0], 2), ("c", [7.0], 1)],
                                "token string, embedding array<float>, seq int")
    got = {r.token: list(r.embedding) for r in vs.upsert_vectors(store, upd, "seq").collect()}
    assert got == {"a": [1.0], "b": [6.0], "c": [7.0]}


def test_export_filter_and_csv(spark):
    store = _vecs(spark, [("word", [1.0, 2.0]), ('"q', [1.0, 1.0]), ("\\x", [0.0, 1.0]),
                          ("!ok", [3.0, 4.0]), (" sp", [1.0, 1.0]), ("é", [0.5, 0.5])])
    rows = vs.export_rows(store)
    assert rows.columns == ["token", "embedding1", "embedding2"]
    assert sorted(r.token for r in rows.collect()) == ["!ok", "word", "é"]
    path = tempfile.mkdtemp(prefix="wl-csv-") + "/out"
    assert vs.export_csv(store, path) == 3
    text = "".join(open(p).read() for p in glob.glob(path + "/part-*.csv"))
    assert '"token","embedding1","embedding2"' in text and '"word","1.0","2.0"' in text


def test_blocked_similarity_matches_broadcast(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows.append(("zero", [0.0] * 8))
    v = spark.createDataFrame(rows, "token string, embedding array<double>")
    q = v.select(F.col("token").alias("query"), "embedding")
    a = sim.similar_tokens(q, v, 5).collect()
    b = sim.similar_tokens(q, v, 5, max_broadcast_rows=0, block_rows=16).collect()
    key = lambda r: (r.query, r.rank)
    assert [(r.query, r.token, r.rank) for r in sorted(a, key=key)] == \
           [(r.query, r.token, r.rank) for r in sorted(b, key=key)]
    # brute force
    M = {t: np.array(e) for t, e in rows}
    for qt in ["t0", "t7"]:
        sims = sorted(((-(M[qt] @ M[t]) / (np.linalg.norm(M[qt]) * np.linalg.norm(M[t])), t)
                       for t in M if np.linalg.norm(M[t]) > 0))
        want = [t for _, t in sims[:5]]
        assert [r.token for r in sorted(a, key=key) if r.query == qt] == want


def test_repeated_query_keys_in_both_forms(spark):
    """Same key and vector: one query; same key with another vector: ranked on its own."""
    v = _vecs(spark, [(f"t{i}", [float(i), 1.0]) for i in range(8)])
    q = spark.createDataFrame([("k", [1.0, 1.0]), ("k", [1.0, 1.0]), ("k", [5.0, 1.0])], "query string, embedding array<float>")
    forms = [sorted(map(tuple, sim.similar_tokens(q, v, 2, **kw).select("query", "token", "rank").collect()))
             for kw in ({}, {"max_broadcast_rows": 0, "block_rows": 3})]
    assert forms[0] == forms[1]
    assert sorted(r[2] for r in forms[0]) == [1, 1, 2, 2] and {r[1] for r in forms[0] if r[2] == 1} == {"t1", "t5"}


def test_similarity_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(20_000, 8))
    names = np.array([f"t{i}" for i in range(len(V))], dtype=object)
    whole = sim.topn_block(list(range(40)), V[:40], names, V, 3)
    monkeypatch.setattr(sim, "TILE_BYTES", 8 * len(V) * 7)
    assert sim.topn_block(list(range(40)), V[:40], names, V, 3)[:2] == whole[:2]
