"""Documents as arrays against the row form: ids, positions, sampling flags, chunks."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import arrays as ar
from wordloom.operators import samples as sm
from wordloom.operators import vocab as vc

TEXTS = [(1, "the cat sat on the mat"), (2, "the dog, the dog!"), (3, ""), (4, "x" * 70 + " the rare one"), (2, "a second row of two"),
         (None, "no id"), (None, "the same"), (9, "the end " * 40), (-5, "minus")]


def forms(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, output string").select("doc_id", F.lit("").alias("input"), F.lit("c").alias("context"), "output")
    return vc.token_occurrences(docs), vc.token_arrays(docs)


def rows(df):
    return sorted(map(repr, df.collect()))


def no_shuffle_of_tokens(monkeypatch):
    from wordloom.operators import joins

    def refuse(*a, **k):
        raise AssertionError("tokens were joined one by one")
    for module in (vc, sm, joins):
        monkeypatch.setattr(module, "salted_lookup", refuse)


@pytest.mark.parametrize("hot, how", [(3, "inner"), (0, "left")])
def test_ids_are_those_of_the_row_form(spark, monkeypatch, hot, how):
    occ, arrays = forms(spark)
    vocab = vc.build_vocabulary(occ.filter(F.col("token") != "dog"))
    expected = rows(vc.encode_tokens(occ, vocab, how).select("doc_id", "pos", "token_id"))
    monkeypatch.setattr(ar.hot_tokens, "__defaults__", (hot, 64))
    no_shuffle_of_tokens(monkeypatch)
    assert rows(ar.as_rows(vc.encode_tokens(arrays, vocab, how))) == expected


@pytest.mark.parametrize("chunk, gaps", [(4, True), (4096, False)])
def test_flags_and_chunks_are_those_of_the_row_form(spark, chunk, gaps):
    occ, arrays = forms(spark)
    vocab = vc.build_vocabulary(occ.filter(F.col("token") != "dog") if gaps else occ)
    flagged = [sm.with_sampling_flag(sm.encode_with_stats(o, vocab), 2, 1e-2, 7, 3) for o in (occ, arrays)]
    by_row, by_array = (sm.id_chunks(f, 3, 2, True, chunk) for f in flagged)
    cols = ["doc_id", "chunk", "first", "size", "ids", "keep"]
    assert rows(by_array.select(cols)) == rows(by_row.select(cols)) != []
    assert rows(sm.id_arrays(flagged[1], True)) == rows(sm.id_arrays(flagged[0], True))


def test_hot_tokens_are_bounded(spark):
    vocab = spark.createDataFrame([(i, f"t{i}", n) for i, n in enumerate([5, 9, 5, 1, 7])] + [(9, "y" * 65, 99)], "token_id long, token string, occurrences long")
    assert sorted(ar.hot_tokens(vocab, 3).column("token").to_pylist()) == ["t1", "t4"]
    assert sorted(ar.hot_tokens(vocab, 4).column("token").to_pylist()) == ["t0", "t1", "t2", "t4"]
    assert ar.hot_tokens(vocab, 0).num_rows == 0


def test_windows_of_kept_targets_only_and_radius_of_the_seeded_draw(spark):
    """A radius is drawn for kept targets alone, by the md5 that the SQL names."""
    from wordloom.functions.vector import seeded_uniform
    docs = spark.createDataFrame([(None, [1, 2, 3, 4, 5, 6, 7], [True, False] * 3 + [True]), (5, list(range(30)), [i % 3 == 0 for i in range(30)])],
                                 "doc_id long, ids array<long>, keep array<boolean>")
    every = sm.symmetric_windows(docs, 3, True, 7, 2)
    assert rows(sm.symmetric_windows(docs, 3, True, 7, 2, only_kept=True)) == rows(every.filter("keep")) != []
    radius = F.floor(seeded_uniform(7, F.lit(2), F.lit("radius"), "doc_id", "pos") * 3) + 1
    assert every.filter((F.size("left") != radius) | (F.size("right") != radius)).count() == 0
    assert {x.pos for x in every.collect() if x.doc_id is None} == {3}
