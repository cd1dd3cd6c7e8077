from pyspark.sql import functions as F

from wordloom.operators.joins import hot_keys, salted_lookup


def test_hot_key_third_of_rows(spark):
    # one key holds a third of all fact rows; some keys are absent from the dimension
    facts = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
         .alias("key"))
    dim = (spark.range(90).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
                                  (F.col("id") * 10).alias("val"), F.lit(10).cast("long").alias("w"))
                .unionByName(spark.createDataFrame([("HOT", -1, 1000)], "key string, val long, w long")))
    assert [r.key for r in hot_keys(dim, "key", "w", 0.2).collect()] == ["HOT"]
    for how in ("inner", "left"):
        got = salted_lookup(facts, dim, "key", weight_col="w", how=how, hot_share=0.2, salt_buckets=8)
        want = facts.join(dim, "key", how)
        cols = ["row", "key", "val", "w"]
        assert sorted(map(tuple, got.select(cols).collect()), key=str) == \
               sorted(map(tuple, want.select(cols).collect()), key=str)
