"""The pivot index against a full scan, its share of reads, and comparing by token."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import pivots as pv
from wordloom.operators import similarity as sim


def vectors(spark, m, names=None):
    rows = [(names[i] if names else f"t{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "token string, embedding array<double>")


def found(df):
    return sorted((r.query, r.rank, r.token, None if r.similarity is None else round(r.similarity, 9)) for r in df.collect())


def clustered(n, dims=8, centres=40, noise=.03, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))


@pytest.mark.parametrize("top_n", [1, 7])
@pytest.mark.parametrize("part_rows, query_rows", [(20_000, 20_000), (10, 7)])
def test_index_gives_what_a_full_scan_gives(spark, top_n, part_rows, query_rows):
    m = np.vstack([clustered(300), np.random.default_rng(1).normal(size=(60, 8)), np.zeros((3, 8)), clustered(300)[:20]])
    v = vectors(spark, m)
    q = vectors(spark, np.vstack([m[::17], np.zeros((1, 8)), -m[:3], m[5:6] * 4])).withColumnRenamed("token", "query")
    index = pv.build_pivot_index(v, 16, part_rows)
    got, share = pv.search_pivot_index(index, q, top_n, query_rows=query_rows)
    assert found(got) == found(sim.similar_tokens(q, v, top_n))
    assert 0 < share.first().share <= 1


def test_clustered_vectors_are_read_in_part(spark):
    m = clustered(20_000, seed=3)
    v, q = vectors(spark, m), vectors(spark, m[::100] * 2).withColumnRenamed("token", "query")
    got, share = pv.search_pivot_index(pv.build_pivot_index(v), q, 10)
    assert found(got) == found(sim.similar_tokens(q, v, 10))
    assert share.first().share < 1 / 3 and share.first().cells_read > 0


def test_fewer_vectors_than_asked_for_repeated_keys_and_none(spark):
    v = vectors(spark, np.array([[1., 0], [0, 1], [0, 0], [1, 0]]), ["b", "a", "z", "a2"])
    q = spark.createDataFrame([("x", [1., 0.]), ("x", [1., 0.]), ("x", [0., 3.]), ("y", [0., 0.]), ("w", [1.0])], "query string, embedding array<double>")
    index = pv.build_pivot_index(v, 2)
    got, _ = pv.search_pivot_index(index, q, 10)
    assert found(got) == found(sim.similar_tokens(q, v, 10)) and got.count() == 16
    assert pv.search_pivot_index(index, q.filter("false"), 3)[0].collect() == []
    none = pv.build_pivot_index(v.filter("false"))
    assert pv.search_pivot_index(none, q, 3)[0].collect() == []


def test_compare_by_token_tells_what_is_not_indexed(spark):
    v = vectors(spark, np.array([[1., 0], [.9, .1], [0, 1]]), ["a", "b", "c"])
    q = spark.createDataFrame([("a",), ("a",), ("nope",), ("c",)], "query string")
    got = sorted((r.query, r.indexed, r.rank or 0, r.token) for r in sim.compare_tokens(q, v, 2).collect())
    assert got == [("a", True, 1, "a"), ("a", True, 2, "b"), ("c", True, 1, "c"), ("c", True, 2, "b"), ("nope", False, 0, None)]


def test_tiles_do_not_change_the_best(monkeypatch):
    m = np.round(np.random.default_rng(2).normal(size=(50, 3)), 1)
    side = sim.Side(np.array([f"{i % 20:02d}" for i in range(50)], dtype=object), m)
    whole = [x.tolist() for x in sim.topn_side(m, side, 4)]
    monkeypatch.setattr(sim, "TILE_BYTES", 8 * 50 * 3)
    assert [x.tolist() for x in sim.topn_side(m, side, 4)][:2] == whole[:2]
    assert all(whole[0].count(i) == 4 for i in range(50))


def test_a_query_goes_to_a_shelf_once_and_in_small_batches(spark):
    """Where no cell can be ruled out a query was copied with its vector for each cell, all copies of a batch at once."""
    m = np.random.default_rng(5).normal(size=(3000, 24))
    v = vectors(spark, m)
    index = pv.build_pivot_index(v, 64, part_rows=1000)
    shelves = index.cells.select("shelf").distinct().count()
    assert index.cells.groupBy("shelf").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 1000 and 3 <= shelves <= 6
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"query": str(i), "qid": i, "qvec": [float(x) for x in row], "worst": None, "found": 0} for i, row in enumerate(m)])
    probed = list(pv._probes(index, 10, True)([batch]))
    assert max(b.num_rows for b in probed) <= pv.PROBED
    rows = [(q, s) for b in probed for q, s in zip(b.column("qid").to_pylist(), b.column("shelf").to_pylist())]
    assert len(rows) == len(set(rows)) <= 3000 * shelves
