"""Chat exports as documents.

A chat export is nested JSON (``schemas.CHAT_EXPORT``).  It is flattened to
one row per message ``(chat_id, turn, server, channel, topic, author,
content)``; the document builders work on that flat table, so any message
table (e.g. a conversations log) can feed them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import CHAT_EXPORT
from ..session import materialize

# Header and message markup of chat documents.
SERVER_OPEN, SERVER_CLOSE = "<server>", "</server>"
CHANNEL_OPEN, CHANNEL_CLOSE = "<channel>#", "</channel>"
TOPIC_OPEN, TOPIC_CLOSE = "<topic>", "</topic>"
AUTHOR_OPEN, AUTHOR_CLOSE = "<author>@", "</author>"
MESSAGE_OPEN, MESSAGE_SEP, MESSAGE_CLOSE = "<message>@", ": ", "</message>"


def parse_chat_exports(files: DataFrame, path_col: str = "path", text_col: str = "value",
                       chat_id: str | None = None, lowercase: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, failures) of chat exports, each a row with its path and its whole text.

    The schema is explicit (never inferred); unknown fields are ignored.  Every
    file lands in exactly one channel: ``messages`` has a row per message,
    ``failures`` a row ``path, reason, text`` per file whose text is no JSON
    (``malformed``) or has no message list of that schema (``no messages``).
    ``chat_id`` is a 64-bit hash of the path, so a chat keeps its id whatever the
    partitioning, or a column of ``files``.
    """
    text = F.lower(text_col) if lowercase else F.col(text_col)   # the whole export is lowercased, so names and topic too
    parsed = files.select(F.col(path_col).alias("__path"), F.col(text_col).alias("__text"),
                          (F.xxhash64(path_col) if chat_id is None else F.col(chat_id)).alias("chat_id"),
                          F.from_json(text, CHAT_EXPORT).alias("x"))
    # A corrupt-record column would not do: the optimizer prunes the schema beside it, and then good records count as corrupt.
    reason = F.when(F.try_parse_json("__text").isNull(), "malformed").when(F.col("x.messages").isNull(), "no messages")
    failures = parsed.select(F.col("__path").alias("path"), reason.alias("reason"), F.col("__text").alias("text")).filter(
        F.col("reason").isNotNull())
    messages = parsed.filter(reason.isNull()).select(
        "chat_id",
        F.col("x.guild.name").alias("server"),
        F.col("x.channel.name").alias("channel"),
        F.col("x.channel.topic").alias("topic"),
        F.posexplode("x.messages").alias("turn", "m"),
    ).select("chat_id", F.col("turn").cast("long").alias("turn"), "server", "channel", "topic",
             F.col("m.author.name").alias("author"), F.col("m.content").alias("content"))
    return messages, failures


def chat_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: the whole text of every file (one chat each)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_chat_exports(spark: SparkSession, path: str, lowercase: bool = False,
                      corrupt_col: str | None = None) -> DataFrame:
    """Read chat-export JSON files (one chat per file) into message rows.

    See :func:`parse_chat_exports`.  With ``corrupt_col`` a file that can't be
    read is one row that has its chat's id and its text in that column, and
    nothing else; without it such files are left to :func:`read_chat_failures`.
    """
    messages, failures = parse_chat_exports(chat_files(spark, path), lowercase=lowercase)
    if corrupt_col is None:
        return messages
    return messages.withColumn(corrupt_col, F.lit(None).cast("string")).unionByName(
        failures.select(F.xxhash64("path").alias("chat_id"), F.col("text").alias(corrupt_col)), allowMissingColumns=True)


def read_chat_failures(spark: SparkSession, path: str) -> DataFrame:
    """``path, reason, text`` of the files that :func:`read_chat_exports` can't read."""
    return parse_chat_exports(chat_files(spark, path))[1]


def chat_header(server="server", channel="channel", topic="topic") -> Column:
    """``<server>S</server><channel>#C</channel><topic>T</topic>`` (null topic -> '')."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(SERVER_OPEN), F.coalesce(c(server), F.lit("")), F.lit(SERVER_CLOSE),
                    F.lit(CHANNEL_OPEN), F.coalesce(c(channel), F.lit("")), F.lit(CHANNEL_CLOSE),
                    F.lit(TOPIC_OPEN), F.coalesce(c(topic), F.lit("")), F.lit(TOPIC_CLOSE))


def _neighbours(batches):
    """Of sorted rows (latest message of a chat first): later messages of the chat in this partition, and the message before.

    ``__prev`` is the next row's content if that row is of the same chat; the
    last row of each batch waits for the next batch.
    """
    held, chat, seen = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        held = rows.slice(rows.num_rows - 1)
        yield from _numbered(rows, rows.num_rows - 1, chat, seen)
        same = _same_as_before(rows.column("chat_id"))
        start = np.flatnonzero(~same)
        first = int(start[-1]) if len(start) else 0
        joins = first == 0 and chat is not None and rows.column("chat_id")[0].as_py() == chat[0]
        seen = rows.num_rows - 1 - first + (seen if joins else 0)
        chat = (held.column("chat_id")[0].as_py(),)
    if held is not None:
        yield from _numbered(held, 1, chat, seen)


def _same_as_before(chats: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it; nulls are equal."""
    codes = pc.fill_null(chats.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate([[False], codes[1:] == codes[:-1]])


def _numbered(rows: pa.RecordBatch, n: int, chat, seen: int):
    """The first ``n`` rows with ``__later`` and ``__prev``; ``seen`` rows of ``chat`` came before the first one."""
    if not n:
        return
    same = _same_as_before(rows.column("chat_id"))
    at = np.arange(len(same))
    start = np.maximum.accumulate(np.where(same, 0, at))
    later = at - start
    if chat is not None and rows.column("chat_id")[0].as_py() == chat[0]:
        later[start == 0] += seen
    text = rows.column("content")
    follows = pa.array(np.append(same[1:], False))
    prev = pc.if_else(follows, pa.concat_arrays([text.slice(1), pa.nulls(1, text.type)]), pa.nulls(len(text), text.type))
    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(later, pa.int64()), prev],
                                     [*rows.schema.names, "__later", "__prev"]).slice(0, n)


def with_neighbours(msgs: DataFrame) -> DataFrame:
    """Add ``__later`` (messages of the chat behind this one) and ``__prev`` (the content of the one before, null at the start).

    Messages are range-partitioned and sorted once, so that a chat of any size
    spreads over partitions, and numbered inside each partition.  A chat that
    lies in several partitions gets its rest from a table of the partitions'
    edges: at most two rows for each partition, whatever the number of
    messages.  (chat_id, turn) names a message; a null chat_id is a chat too.
    """
    cols = msgs.columns
    sql = ", ".join(f"`{n}` {t}" for n, t in [*msgs.dtypes, ("__later", "bigint"), ("__prev", "string")])
    order = [F.col("chat_id"), F.col("turn").desc()]
    parts = int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(msgs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                            .mapInArrow(_neighbours, sql).withColumn("__pid", F.spark_partition_id()))
    ends = table.groupBy("__pid").agg(F.min(F.struct("chat_id")).alias("a"),
                                      F.max(F.struct("chat_id")).alias("z"))
    edge = (table.join(F.broadcast(ends), "__pid")
                 .filter(F.struct("chat_id").eqNullSafe(F.col("a")) | F.struct("chat_id").eqNullSafe(F.col("z")))
                 .groupBy("__pid", "chat_id").agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("content"), "turn").alias("__top")))
    chat = Window.partitionBy("chat_id").orderBy("__pid")
    carry = edge.select(F.col("__pid").alias("__p"), F.col("chat_id").alias("__c"),
                        (F.sum("__n").over(chat) - F.col("__n")).alias("__ahead"), "__n",
                        F.lead("__top").over(chat).alias("__next"))
    rows = table.join(F.broadcast(carry), (F.col("__pid") == F.col("__p")) & F.col("chat_id").eqNullSafe(F.col("__c")), "left")
    last_here = F.col("__later") + 1 == F.col("__n")
    return rows.select(*[F.col(f"`{c}`") for c in cols],
                       (F.col("__later") + F.coalesce("__ahead", F.lit(0))).alias("__later"),
                       F.when(last_here, F.col("__next.content")).otherwise(F.col("__prev")).alias("__prev"))


def last_messages(msgs: DataFrame, n: int) -> DataFrame:
    """Keep the last ``n`` messages of each chat (0 or n >= size -> all)."""
    if n <= 0:
        return msgs
    return with_neighbours(msgs).filter(F.col("__later") < n).drop("__later", "__prev")


def split_documents(msgs: DataFrame, last_n: int = 0) -> DataFrame:
    """P5: one document per message.

    input = previous kept message ('' for the first), context = header +
    author tag, output = the message.  Returns ``chat_id, turn`` + D1 texts.
    """
    rows = with_neighbours(msgs)
    prev = F.col("__prev")
    if last_n > 0:
        rows = rows.filter(F.col("__later") < last_n)
        prev = F.when(F.col("__later") + 1 < last_n, prev)
    return rows.select(
        "chat_id", "turn",
        F.coalesce(prev, F.lit("")).alias("input"),
        F.concat(chat_header(), F.lit(AUTHOR_OPEN), F.coalesce("author", F.lit("")),
                 F.lit(AUTHOR_CLOSE)).alias("context"),
        F.coalesce("content", F.lit("")).alias("output"),
    )


def merge_documents(msgs: DataFrame, last_n: int = 0) -> DataFrame:
    """One document per chat; messages wrapped and concatenated in turn order.

    Returns ``chat_id`` + D1 texts (input '', context = header).
    """
    kept = last_messages(msgs, last_n).select(
        "chat_id", "turn", "server", "channel", "topic",
        F.concat(F.lit(MESSAGE_OPEN), F.coalesce("author", F.lit("")), F.lit(MESSAGE_SEP),
                 F.coalesce("content", F.lit("")), F.lit(MESSAGE_CLOSE)).alias("msg"))
    merged = kept.groupBy("chat_id", "server", "channel", "topic").agg(
        F.expr("listagg(msg, '') WITHIN GROUP (ORDER BY turn)").alias("output"))
    return merged.select("chat_id", F.lit("").alias("input"), chat_header().alias("context"),
                         "output")


def messages_from_table(df: DataFrame, chat_id="conv_id", turn="turn", author="role",
                        content="text", server=None, channel=None, topic=None) -> DataFrame:
    """Map a flat message log (e.g. ``conversations``) to chat message rows."""
    def c(x, default):
        if x is None:
            return default
        return F.col(x) if isinstance(x, str) else x
    return df.select(
        F.col(chat_id).cast("long").alias("chat_id"), F.col(turn).cast("long").alias("turn"),
        c(server, F.lit(None).cast("string")).alias("server"),
        c(channel, F.lit(None).cast("string")).alias("channel"),
        c(topic, F.lit(None).cast("string")).alias("topic"),
        F.col(author).alias("author"), F.col(content).alias("content"))
