"""Table schemas of the engine (documents, tokens, vocabulary, vectors, chats)."""

from pyspark.sql import types as T

# A document has three texts; the body is ``output``.
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("input", T.StringType(), False),
    T.StructField("context", T.StringType(), False),
    T.StructField("output", T.StringType(), False),
])

# D2 (exploded form): one row per token occurrence.
TOKEN_OCCURRENCE = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("token", T.StringType(), False),
])

# D3: vocabulary row; ids are dense from 1 in order of first appearance.
VOCABULARY = T.StructType([
    T.StructField("token_id", T.LongType(), False),
    T.StructField("token", T.StringType(), False),
    T.StructField("occurrences", T.LongType(), False),
    T.StructField("frequency", T.DoubleType(), False),
])

# Token vector.
TOKEN_VECTOR = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False), False),
])

# Chat export (JSON); unknown fields are ignored, topic may be null.
CHAT_EXPORT = T.StructType([
    T.StructField("guild", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("channel", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("topic", T.StringType(), True),
    ])),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
    ]))),
])

# Flat chat-message table: one row per message, ``turn`` orders a chat.
CHAT_MESSAGE = T.StructType([
    T.StructField("chat_id", T.LongType(), False),
    T.StructField("turn", T.LongType(), False),
    T.StructField("server", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
])
