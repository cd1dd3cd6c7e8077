"""Hot keys found from the rows themselves, and distinct counts that merge."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import CONTEXT_CLOSE, CONTEXT_OPEN, INPUT_CLOSE, INPUT_OPEN, OUTPUT_OPEN
from wordloom.operators import joins as jn
from wordloom.operators import models as md
from wordloom.operators import similarity as sim
from wordloom.operators import vocab as vc


def skewed(spark, n=9000, schema="k long, i long"):
    """One key holds a third of the rows, the others are spread over thousands."""
    rng = random.Random(2)
    return spark.createDataFrame([(7 if i % 3 == 0 else rng.randint(100, 5000), i) for i in range(n)], schema).repartition(5)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_heavy_hitters_find_every_hot_key_and_few_others(spark):
    got = {r.k for r in jn.heavy_hitters(skewed(spark), "k", 0.01).collect()}
    assert got == {7}
    even = spark.range(50_000).select((F.col("id") % 25_000).alias("k"))
    assert jn.heavy_hitters(even, "k", 0.01).count() == 0
    assert jn.heavy_hitters(even.filter("false"), "k").count() == 0
    null = spark.createDataFrame([(None,), (None,), (1,)], "k long")
    assert [r.k for r in jn.heavy_hitters(null, "k", 0.1).collect()] == [1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_keys_from_the_rows_equals_a_plain_join(spark, how):
    facts = skewed(spark)
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(0, 5000, 7)], "k long, v string")
    got = jn.salted_lookup(facts, dim, "k", how=how, hot=jn.heavy_hitters(facts, "k"))
    assert rows(got.select("k", "i", "v")) == rows(facts.join(dim, "k", how).select("k", "i", "v"))


@pytest.mark.parametrize("counted", [True, False])
def test_decoding_with_an_id_that_a_third_of_the_rows_have(spark, counted):
    ids = skewed(spark, schema="token_id long, pos long")
    n = {r.token_id: r["count"] for r in ids.groupBy("token_id").count().collect()}
    vocab = spark.createDataFrame([(k, f"t{k}", c) for k, c in n.items() if k % 5], "token_id long, token string, occurrences long")
    vocab = vocab if counted else vocab.drop("occurrences")
    assert rows(vc.decode_ids(ids, vocab)) == rows(ids.join(vocab.select("token_id", "token"), "token_id", "left"))


def test_vectors_of_a_token_that_a_third_of_the_rows_have(spark):
    tokens = skewed(spark).select(F.concat(F.lit("t"), "k").alias("token"), "i")
    vectors = spark.createDataFrame([(f"t{k}", [float(k)]) for k in range(0, 5000, 7)], "token string, embedding array<float>")
    assert rows(sim.attach_vectors(tokens, vectors)) == rows(tokens.join(vectors, "token", "left"))


def test_prompts_that_share_a_word(spark):
    prompts = spark.createDataFrame([(i, "the " * 10 + (f"w{i}" if i % 2 else "the")) for i in range(300)], "pid long, input string")
    have = [INPUT_OPEN, INPUT_CLOSE, CONTEXT_OPEN, CONTEXT_CLOSE, OUTPUT_OPEN, "the", "w5"]
    got = {r.pid: (r.n_tokens, r.n_missing, r.accepted, r.tokens) for r in
           md.index_prompts(prompts, spark.createDataFrame([(t,) for t in have], "token string"), ["pid"]).collect()}
    assert len(got) == 300 and {i for i, r in got.items() if r[2]} == {i for i in range(300) if i % 2 == 0 or i == 5}
    assert all(len(t) == n and t.count("the") >= 10 for n, _, _, t in got.values())


def test_sketches_of_tokens_merge_and_estimate(spark):
    parts = [spark.range(a, b).select(F.col("id").cast("string").alias("token")) for a, b in ((0, 40_000), (30_000, 70_000), (0, 10), (65_000, 90_000))]
    merged = vc.token_sketch(parts[0])
    for p in parts[1:]:                                   # three merges
        merged = vc.merge_token_sketches(merged, vc.token_sketch(p))
    assert abs(vc.sketch_estimate(merged).first()[0] - 90_000) < 90_000 * 3 / 64     # three standard errors at lg_k = 12


def test_embeddings_come_back_as_stored(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", [1, 2], [.5, .25]), (2, "b", [0, 0], None)], "token_id long, token string, sums array<long>, embedding array<float>")
    md.save_embeddings(e, str(tmp_path / "e"))
    assert rows(md.load_embeddings(spark, str(tmp_path / "e"))) == rows(e)
    with pytest.raises(ValueError):
        md.save_embeddings(e.drop("embedding"), str(tmp_path / "f"))
