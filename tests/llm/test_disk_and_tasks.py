"""Disk and tasks that the operators on pairs and strings take."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from wordloom.llm import jaccard, substrings
from wordloom.session import checkpoint_dir, materialize, temporary_tables


def _rows(n):
    """Texts, every third with a near copy, every fourth with a string of the one before."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(3000)]
    texts = []
    for i in range(n):
        text = draw.choices(words, k=120)
        if i % 3 == 1:
            text = texts[-1].split()
            text[draw.randrange(len(text))] = "changed"
        if i % 4 == 3:
            text[50:70] = texts[-1].split()[20:40]
        texts.append(" ".join(text))
    return list(enumerate(texts))


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([*_rows(120), (None, "a text without id"), (5, None)], "doc_id long, text string")


def _tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("wordloom-")}


def test_tables_of_a_block_are_deleted(spark):
    before = _tables(spark)
    with temporary_tables(spark):
        materialize(spark.range(3))
        with temporary_tables(spark):
            materialize(spark.range(4))
            inner = materialize(spark.range(5), keep=True)
        assert inner.count() == 5 and len(_tables(spark) - before) == 2
        kept = materialize(spark.range(100_001, numPartitions=8), rows=100_001, keep=True)
    assert kept.count() == 100_001 and len(kept.inputFiles()) == 3
    assert len(_tables(spark) - before) == 1
    with pytest.raises(ZeroDivisionError), temporary_tables(spark):
        materialize(spark.range(3))
        raise ZeroDivisionError
    assert len(_tables(spark) - before) == 1


def test_near_duplicates_keeps_only_what_its_rows_need(spark, docs):
    before = _tables(spark)
    kept = jaccard.representatives(docs)
    assert len(_tables(spark) - before) == 1
    near = jaccard.near_duplicates(docs)
    assert len(_tables(spark) - before) <= 1 + 3
    drop = {r.doc_id for r in near.collect() if r.doc_id != r.component_id}
    assert len(drop) >= 30
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in drop)


def test_small_graphs_take_few_tasks(spark):
    """A graph of few edges is not dealt out to all shuffle partitions in every round."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    sc, status = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = materialize(spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        sc.setJobGroup("graph", "components")
        got = {r.node: r.root for r in jaccard.components(edges).collect()}
        stages = {s for j in status.getJobIdsForGroup("graph") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(1, 41), 1)
    assert tasks < 400


def test_texts_are_shuffled_once(spark, docs):
    """Both joins of the texts read one exchange, where sides are too large to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "-1")
        for run in (substrings.dedup, substrings.report):
            got = run(docs)
            assert len(got.collect()) == 122
            assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_anchor_records_are_small():
    texts = _rows(600)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts]})
    size, n = 0, 0
    for b in substrings._anchor_map(50)(iter([batch])):
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
            if kind == "anchors":
                gram, *_, place = substrings._unpack_anchors(blob)
                assert gram.max() <= substrings.KEY and (place & np.uint64(substrings.KEY)).max() < 1200
                size, n = size + len(blob), n + len(gram)
    assert n > 10_000 and size < 24 * n


def test_packed_anchors_come_back():
    draw = np.random.default_rng(1)
    ids, marks = draw.integers(-9, 1 << 60, 20), draw.integers(1 << 23, 1 << 24, 20)
    text = np.sort(draw.integers(3, 20, 200))
    gram, context = (draw.integers(0, 1 << k, 200).astype(np.uint64) for k in (40, 63))
    pos = draw.integers(0, 1 << 40, 200)
    got = substrings._unpack_anchors(substrings._pack_anchors(gram, context, text, pos, ids, marks))
    for a, b in zip(got, (gram, context, ids[text], pos.astype(np.uint64) | marks.astype(np.uint64)[text] << np.uint64(40)), strict=True):
        assert np.array_equal(a, b)


def test_cut_rows_keep_other_columns(spark):
    """Other columns go along, whether or not the row has an id or a text."""
    words = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, ["x"], 1.5), (2, "other " + words, None, None), (None, words, [], 2.0), (3, None, ["y"], 0.0)],
                                 "doc long, text string, b array<string>, z double")
    got = {(r[0], r[1], tuple(r[2]) if r[2] is not None else None, r[3]) for r in substrings.dedup(docs, id_col="doc").collect()}
    assert got == {(1, words, ("x",), 1.5), (2, "other ", None, None), (None, words, (), 2.0), (3, None, ("y",), 0.0)}
