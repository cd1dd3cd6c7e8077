import os
import tempfile

from wordloom.operators import vocab as vc
from wordloom.schemas import DOCUMENT
from wordloom.streaming import vocab_stream as st


def test_stream_merge_equals_batch_and_replay_is_skipped(spark):
    base = tempfile.mkdtemp(prefix="wl-stream-")
    src = base + "/in"
    rows1 = [(1, "", "", "the cat sat"), (2, "", "", "the dog")]
    rows2 = [(3, "", "", "a cat ran"), (4, "", "", "dog and cat")]
    spark.createDataFrame(rows1, DOCUMENT).coalesce(1).write.parquet(src + "/part=1")
    spark.createDataFrame(rows2, DOCUMENT).coalesce(1).write.parquet(src + "/part=2")
    stream = (spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1)
                   .parquet(src + "/*"))
    q = st.stream_vocabulary(stream, base + "/vocab", base + "/ckpt")
    q.awaitTermination(120)
    got = {r.token: (r.token_id, r.occurrences) for r in st.latest_vocabulary(spark, base + "/vocab").collect()}
    all_docs = spark.createDataFrame(rows1 + rows2, DOCUMENT)
    want = {r.token: (r.token_id, r.occurrences) for r in vc.build_vocabulary(vc.token_occurrences(all_docs)).collect()}
    assert got == want
    # replaying a committed batch changes nothing
    run = spark.read.parquet(base + "/vocab/_commits").first().run
    assert run and st.merge_batch(spark.createDataFrame(rows2, DOCUMENT), 0, base + "/vocab", run) is False


def _counts(spark, root):
    return {r.token: r.occurrences for r in st.latest_vocabulary(spark, root).collect()}


def test_a_lost_checkpoint_starts_a_new_run(spark):
    base = tempfile.mkdtemp(prefix="wl-stream-")
    spark.createDataFrame([(1, "", "", "cat dog")], DOCUMENT).coalesce(1).write.parquet(base + "/in/part=1")
    for checkpoint, times in (("/a", 1), ("/a", 1), ("/b", 2)):      # the second start finds nothing new, the third reads all again
        stream = spark.readStream.schema(DOCUMENT).parquet(base + "/in/*")
        st.stream_vocabulary(stream, base + "/vocab", base + checkpoint).awaitTermination(120)
        assert _counts(spark, base + "/vocab")["cat"] == times


def test_old_versions_go_and_half_written_ones_are_replaced(spark):
    root = tempfile.mkdtemp(prefix="wl-stream-") + "/vocab"
    docs = spark.createDataFrame([(1, "", "", "cat dog")], DOCUMENT)
    for batch in range(4):
        if batch == 2:
            docs.write.parquet(f"{root}/v=2")                        # left over from a failure
        assert st.merge_batch(docs, batch, root, "r", keep=2)
        assert _counts(spark, root)["cat"] == batch + 1
    assert sorted(p for p in os.listdir(root) if p.startswith("v=")) == ["v=2", "v=3"]
