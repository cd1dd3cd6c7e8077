"""V5 driven by a stream: merge each micro-batch of documents into the vocabulary.

Each batch writes a new vocabulary version ``<root>/v=<version>`` and then
records ``(version, run, batch_id)`` in ``<root>/_commits``.  A run is a stream
with its checkpoint: batch ids start at 0 again when a checkpoint is lost, but
then the run is another one.  A batch that its run has committed is skipped, so a
replay after a failure changes nothing.  Readers take the latest committed
version; older ones are deleted but for the last few.  The merge itself is the
batch operator (``operators.vocab.merge_vocabulary``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vocab import build_vocabulary, merge_vocabulary, token_occurrences
from ..schemas import VOCABULARY

COMMITS = "version long, run string, batch_id long"


def _commits(spark: SparkSession, root: str):
    path = f"{root}/_commits"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything but "no commit yet" must not look like it
            raise
        return None


def _last_version(spark: SparkSession, root: str) -> int | None:
    commits = _commits(spark, root)
    return commits.agg(F.max("version")).first()[0] if commits is not None else None


def latest_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """The last committed vocabulary version (empty when nothing is committed)."""
    last = _last_version(spark, root)
    if last is None:
        return spark.createDataFrame([], VOCABULARY)
    return spark.read.parquet(f"{root}/v={last}")


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the store that its path names, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def merge_batch(batch: DataFrame, batch_id: int, root: str, run: str = "", keep: int = 3, **tok_opts) -> bool:
    """Merge one batch of D1 documents; returns False when ``run`` had committed it already.

    ``keep`` versions stay, so that readers of the one before can end.
    """
    if keep < 1:
        raise ValueError("the last version has to stay")
    spark = batch.sparkSession
    commits = _commits(spark, root)
    if commits is not None and commits.filter((F.col("run") == run) & (F.col("batch_id") == batch_id)).limit(1).count() > 0:
        return False
    last = _last_version(spark, root)
    version = 0 if last is None else last + 1
    occ = token_occurrences(batch, **tok_opts)
    current = latest_vocabulary(spark, root)
    if current.limit(1).count() == 0:
        merged = build_vocabulary(occ)
    else:
        merged = merge_vocabulary(current, occ)
    # A version without a commit is left over from a failure and is written anew.
    merged.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark.createDataFrame([(version, run, int(batch_id))], COMMITS).write.mode("append").parquet(f"{root}/_commits")
    if version >= keep:
        _delete(spark, f"{root}/v={version - keep}")
    return True


def _run_of(batch: DataFrame) -> str:
    """The stream's id, which its checkpoint keeps over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def stream_vocabulary(docs_stream: DataFrame, root: str, checkpoint_location: str,
                      available_now: bool = True, keep: int = 3, **tok_opts):
    """Start the streaming merge; returns the StreamingQuery."""
    writer = (docs_stream.writeStream
                         .foreachBatch(lambda df, bid: merge_batch(df, bid, root, _run_of(df), keep, **tok_opts))
                         .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
