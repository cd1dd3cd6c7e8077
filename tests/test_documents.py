import json
import os
import tempfile

from wordloom.sources import chat as ch
from wordloom.sources import documents as dc


def _three(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "doc_id long, body string")
    return dc.build_documents(df, output="body")


def test_store_lookup_count(spark):
    docs = _three(spark)
    assert [r.output for r in docs.orderBy("doc_id").collect()] == ["alpha", "beta", "gamma"]
    assert dc.lookup_document(docs, 2).first().output == "beta"
    assert dc.lookup_document(docs, 7).count() == 0
    assert dc.count_documents(docs).first()[0] == 3
    ids = spark.createDataFrame([(3,), (9,)], "doc_id long")
    got = {r.doc_id: r.output for r in dc.lookup_documents(docs, ids).collect()}
    assert got == {3: "gamma", 9: None}


def test_append_and_write(spark):
    docs = _three(spark)
    new = dc.build_documents(spark.createDataFrame([(0, "zz"), (0, "aa")], "doc_id long, t string"), output="t")
    app = dc.append_documents(docs, new.drop("doc_id"), ["output"])
    assert sorted((r.doc_id, r.output) for r in app.collect()) == [(4, "aa"), (5, "zz")]
    path = tempfile.mkdtemp(prefix="wl-docs-")
    dc.write_documents(docs, path + "/t", mode="overwrite")
    dc.write_documents(app, path + "/t", mode="append")
    assert dc.read_documents(spark, path + "/t").count() == 5


def test_text_files_source(spark):
    d = tempfile.mkdtemp(prefix="wl-text-")
    for name, body in [("a.txt", "First File\nline two"), ("b.txt", "Second")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    docs = dc.read_text_documents(spark, d, lowercase=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.output) for r in docs] == [(1, "first file\nline two"), (2, "second")]
    assert docs[0].input == "" and docs[0].context == ""


CHAT = {"guild": {"name": "Guild"}, "channel": {"name": "general", "topic": None, "extra": 1},
        "messages": [{"content": "hi", "author": {"name": "ann"}, "id": 1},
                     {"content": "hello", "author": {"name": "bob"}},
                     {"content": "bye", "author": {"name": "ann"}}]}


def _chat(spark):
    d = tempfile.mkdtemp(prefix="wl-chat-")
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump(CHAT, f, indent=1)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not json")
    return ch.read_chat_exports(spark, d)


def test_chat_split_and_merge(spark):
    msgs = _chat(spark)
    assert msgs.count() == 3
    header = "<server>Guild</server><channel>#general</channel><topic></topic>"
    split = split_rows = [(r.input, r.context, r.output) for r in ch.split_documents(msgs).orderBy("turn").collect()]
    assert [s[0] for s in split] == ["", "hi", "hello"]
    assert split_rows[1][1] == header + "<author>@bob</author>"
    merged = ch.merge_documents(msgs).collect()
    assert len(merged) == 1
    assert merged[0].context == header
    assert merged[0].output == "<message>@ann: hi</message><message>@bob: hello</message><message>@ann: bye</message>"
    last2 = [r.input for r in ch.split_documents(msgs, last_n=2).orderBy("turn").collect()]
    assert last2 == ["", "hello"]
    assert ch.split_documents(msgs, last_n=0).count() == 3
    assert ch.split_documents(msgs, last_n=9).count() == 3


def test_chat_lowercase(spark):
    d = tempfile.mkdtemp(prefix="wl-chat-")
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump(CHAT, f)
    msgs = ch.read_chat_exports(spark, d, lowercase=True)
    assert {r.server for r in msgs.collect()} == {"guild"}


def test_chat_corrupt_files_kept_aside(spark):
    d = tempfile.mkdtemp(prefix="wl-chat-")
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump(CHAT, f)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not json")
    with open(os.path.join(d, "none.json"), "w") as f:
        f.write('{"guild": {"name": "g"}}')
    with open(os.path.join(d, "empty.json"), "w") as f:
        f.write('{"messages": []}')
    assert ch.read_chat_exports(spark, d).count() == 3
    rows = ch.read_chat_exports(spark, d, corrupt_col="_corrupt").collect()
    assert sorted(r._corrupt for r in rows if r._corrupt) == ['{"guild": {"name": "g"}}', "{not json"]
    assert sum(r._corrupt is None and r.content is not None for r in rows) == 3
    failed = {os.path.basename(r.path): (r.reason, r.text) for r in ch.read_chat_failures(spark, d).collect()}
    assert failed == {"bad.json": ("malformed", "{not json"), "none.json": ("no messages", '{"guild": {"name": "g"}}')}


def test_chat_files_become_documents_to_append(spark):
    d = tempfile.mkdtemp(prefix="wl-chat-")
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump(CHAT, f)
    store = dc.build_documents(spark.createDataFrame([(7, "old")], "doc_id long, text string"), output="text")
    new = ch.merge_documents(ch.read_chat_exports(spark, d))
    added = dc.append_documents(store, new, ["chat_id"]).collect()
    assert [r.doc_id for r in added] == [8] and added[0].output.count("<message>@") == 3


def test_neighbours_over_partition_edges(spark):
    """A chat over many partitions and batches, small chats, a null chat, null contents: against a plain count."""
    sizes = {1: 3, 2: 400, 3: 1, None: 5, 7: 60}
    rows = [(c, t, None if t % 11 == 3 else f"{c}-{t}") for c, n in sizes.items() for t in range(0, 2 * n, 2)]
    msgs = spark.createDataFrame(rows[::-1], "chat_id long, turn long, content string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("1", "7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r.chat_id, r.turn): (r.content, r["__later"], r["__prev"]) for r in ch.with_neighbours(msgs).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        texts = {(c, t): x for c, t, x in rows}
        assert got == {(c, t): (x, sizes[c] - 1 - t // 2, texts.get((c, t - 2))) for c, t, x in rows}
    last = ch.last_messages(msgs, 4).collect()
    assert sorted((r.chat_id or 0, r.turn) for r in last) == sorted((c or 0, t) for c, t, _ in rows if t // 2 >= sizes[c] - 4)
    assert ch.with_neighbours(msgs.limit(0)).count() == 0
