from pyspark.sql import functions as F

from wordloom.operators import vocab as vc
from wordloom.sources.documents import build_documents


def _occ(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pos long, token string")


def test_two_tokens_once_each(spark):
    v = vc.build_vocabulary(_occ(spark, [(1, 0, "first"), (1, 1, "second")]))
    got = sorted((r.token_id, r.token, r.occurrences, r.frequency) for r in v.collect())
    assert got == [(1, "first", 1, 0.5), (2, "second", 1, 0.5)]
    assert vc.token_by_value(v, "missing").count() == 0
    assert vc.token_by_id(v, 2).first().token == "second"


def test_ids_follow_first_appearance(spark):
    occ = _occ(spark, [(2, 0, "c"), (1, 5, "b"), (1, 1, "a"), (2, 1, "a"), (3, 0, "d")])
    v = {r.token: r.token_id for r in vc.build_vocabulary(occ).collect()}
    assert v == {"a": 1, "b": 2, "c": 3, "d": 4}


def _corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return build_documents(d, output="text", context="source")


def test_invariants_and_partition_invariance(spark):
    from tests.conftest import SF001
    docs = _corpus(spark, SF001)
    a = vc.build_vocabulary(vc.token_occurrences(docs.repartition(1))).collect()
    b = vc.build_vocabulary(vc.token_occurrences(docs.repartition(7))).collect()
    ids = sorted(r.token_id for r in a)
    assert ids == list(range(1, len(a) + 1))
    assert abs(sum(r.frequency for r in a) - 1.0) < 1e-9
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_merge_keeps_ids_and_appends(spark):
    v = vc.build_vocabulary(_occ(spark, [(1, 0, "a"), (1, 1, "b")]))
    merged = vc.merge_vocabulary(v, _occ(spark, [(9, 0, "c"), (9, 1, "a"), (9, 2, "d")]))
    got = {r.token: (r.token_id, r.occurrences) for r in merged.collect()}
    assert got == {"a": (1, 2), "b": (2, 1), "c": (3, 1), "d": (4, 1)}
    assert abs(sum(r.frequency for r in merged.collect()) - 1.0) < 1e-12


def test_extend_counts_new_tokens_once(spark):
    v = vc.build_vocabulary(_occ(spark, [(1, 0, "a"), (1, 1, "a")]))
    ext = vc.extend_vocabulary(v, _occ(spark, [(5, 0, "z"), (5, 1, "z"), (5, 2, "a")]))
    got = {r.token: (r.token_id, r.occurrences) for r in ext.collect()}
    assert got == {"a": (1, 2), "z": (2, 1)}


def test_encode_decode_with_hot_keys(spark):
    rows = [(d, p, "hot" if p % 2 == 0 else f"t{d}") for d in range(50) for p in range(6)]
    occ = _occ(spark, rows)
    v = vc.build_vocabulary(occ)
    enc = vc.encode_tokens(occ, v, hot_share=0.1, salt_buckets=4)
    assert enc.count() == len(rows)
    dec = vc.decode_ids(enc.select("doc_id", "pos", "token_id"), v)
    assert sorted((r.doc_id, r.pos, r.token) for r in dec.collect()) == sorted(rows)


def test_distinct_count(spark):
    occ = _occ(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")])
    assert vc.distinct_token_count(occ).first()[0] == 2


def test_vocabulary_store_round_trip(spark):
    import tempfile
    v = vc.build_vocabulary(_occ(spark, [(1, 0, "x"), (1, 1, "y"), (2, 0, "x")]))
    path = tempfile.mkdtemp(prefix="wl-vocab-") + "/v"
    vc.write_vocabulary(v, path)
    back = vc.read_vocabulary(spark, path, ordered=True).collect()
    assert [(r.token_id, r.token, r.occurrences) for r in back] == [(1, "x", 2), (2, "y", 1)]
