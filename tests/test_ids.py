import random

from wordloom.operators.ids import dense_ids


def test_dense_ids_match_brute_force(spark):
    rnd = random.Random(3)
    keys = list({(rnd.randrange(50), rnd.randrange(1000)) for _ in range(3000)})
    df = spark.createDataFrame(keys, "a long, b long").repartition(7)
    got = {(r.a, r.b): r.id for r in dense_ids(df, ["a", "b"], start=10, num_partitions=5).collect()}
    want = {k: i + 10 for i, k in enumerate(sorted(keys))}
    assert got == want
