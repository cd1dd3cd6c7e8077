"""Steps that all window queries share: counts from arrays, sorted indices, the draw's hash, sketches in NumPy."""

import hashlib

from pyspark.sql import functions as F

from wordloom.operators import arrays as ar
from wordloom.operators import cooccurrence as co
from wordloom.operators import samples as sm
from wordloom.operators import vocab as vc


def test_counts_of_arrays_equal_counts_of_rows(spark):
    """Documents out of order, that share a doc_id, without one, and without tokens."""
    docs = [(7, ["a", "b", "a"]), (3, ["b", "c"]), (3, ["c", "d", "b"]), (None, ["e", "a", "e"]), (1, []), (2, None), (9, ["d", "f"])]
    for parts in (1, 3):
        arrays = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(parts)
        rows = arrays.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
        assert sorted(map(repr, vc.count_tokens(arrays).collect())) == sorted(map(repr, vc.count_tokens(rows).collect())) != []
    many = spark.createDataFrame([(i, ["x", "y"] * 50) for i in range(40)], "doc_id long, tokens array<string>").coalesce(1)
    assert sorted(map(tuple, ar.count_array_tokens(many).collect())) == [("x", 0, 0, 2000), ("y", 0, 1, 2000)]


def test_multi_hot_sorts_without_a_function_and_null_stands_last(spark):
    lists = [[3, 1, None, 1], [], None, [None, None], [2, 2], [None, 5]]
    df = spark.createDataFrame([(x,) for x in lists], "c array<long>").select(sm.multi_hot("c").alias("got"))
    assert [r.got for r in df.collect()] == [[1, 3, None], [], None, [None], [2], [5, None]]
    assert "array_sort" not in df._jdf.queryExecution().analyzed().toString()


def test_the_draw_hashes_a_row_once_in_a_pass(spark):
    s = spark.range(0, 400, 1, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("pos"))
    drawn = sorted(range(400), key=lambda d: (hashlib.md5(b"5|validation|%d|1" % d).hexdigest()[:8], d))
    for share, cap, k in ((0.15, 10, 10), (0.15, 1000, 60), (1.0, 1000, 400), (0.0, 10, 0), (0.15, 0, 0)):
        out = sm.train_validation_split(s, seed=5, share=share, cap=cap)
        assert {r.doc_id for r in out.collect() if r.validation} == set(drawn[:k]) and out.count() == 400
        assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 1


def test_sketch_lists_no_pair_as_a_row(spark):
    rows = [([1, 2], [3]), ([2], [1, 3, 9]), ([4, 1], [2, 5]), ([], [1]), ([1], []), (None, [1]), ([None, 2], [None])]
    samples = spark.createDataFrame(rows, "inputs array<long>, outputs array<long>").repartition(2)
    for dims in (5, 40):
        sketch = co.cooccurrence_sketch(samples, dims, 7)
        assert "Generate" not in sketch._jdf.queryExecution().executedPlan().toString()
        want = {}
        for x, y in ((x, y) for a, b in rows for x in a or [] for y in b):
            texts = ["7|sign|%d" % k + ("" if y is None else f"|{y}") for k in range(2)]
            digits = "".join(hashlib.md5(t.encode()).hexdigest() for t in texts)[:dims]
            n, sums = want.get(x, (0, [0] * dims))
            want[x] = n + 1, [s + (1 if c >= "8" else -1) for s, c in zip(sums, digits, strict=True)]
        assert {r.token_id: (r.n_pairs, r.sums) for r in sketch.collect()} == want
