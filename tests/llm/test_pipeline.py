"""The pipeline's rows against its stages done by brute force."""

import hashlib
import random
import tracemalloc

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from wordloom.llm import bpe, decontam, jaccard, substrings

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {d: t.encode() for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    sets = {}
    for d, b in texts.items():
        w = b.lower().split()
        sets[d] = {tuple(w)} if len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    seen, left = set(), {}
    for d in sorted(d for d in texts if find(d) == d):
        b = texts[d]
        cov, wins = bytearray(len(b)), [b[i:i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(wins):
            if w in seen:
                cov[i:i + 50] = b"\1" * 50
        seen.update(wins)
        left[d] = bytes(x for x, c in zip(b, cov) if not c).decode(errors="ignore")
    left = {d: t for d, t in left.items() if t.strip()}
    bench = decontam.Benchmark([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for d, t in left.items():
        (spans, _), = bench.search([decontam.alnum_words(t.encode())])
        t = decontam.cut(t.encode(), spans).decode()
        if t.strip():
            want[d] = hashlib.sha256(str(enc.encode(t).tolist()).encode()).hexdigest()
    got = {r.doc_id: hashlib.sha256(str(list(r.ids)).encode()).hexdigest() for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_unlabelled_documents_stay(spark):
    """Without a model only documents without letters go."""
    rows = [(1, "the house", None), (2, "123 -- 4", None), (3, None, None), (4, "\u0e27\u0e31\u0e19 7", None), (5, "", None), (6, " \n\u00e9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 4, 6}


def _held(fn, batches):
    """MB that a map task holds at most beside its input, and its largest output batch."""
    tracemalloc.start()
    largest = max(b.nbytes for b in fn(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6, largest / 1e6


def test_map_tasks_hold_little():
    """What a task holds follows neither its input nor its batches."""
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(5000)]
    batches = [pa.RecordBatch.from_pydict({"doc": pa.array(range(at, at + 500), pa.int64()), "text": texts[at:at + 500]})
               for at in range(0, 5000, 500)]
    peak, largest = _held(substrings._anchor_map(8), batches)
    assert peak < 40 and largest < 5
    peak, largest = _held(jaccard._set_map(8), batches)
    assert peak < 21 and largest < 3
    routed = [b.filter(pa.array([k == "anchors" for k in b.column("kind").to_pylist()])) for b in substrings._anchor_map(1)(iter(batches))]
    peak, _ = _held(substrings._anchor_reduce, routed)
    assert peak < 3.2 * sum(b.nbytes for b in routed) / 1e6


def test_stages_send_small_batches(spark):
    """Whole texts go to Python in batches of BATCH_ROWS rows; a smaller setting of the session stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
                                             F.lit(None).cast("string").alias("lang"))
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(rows, "10000")
            stage(spark, docs, SF)
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
            assert max(r.n for r in sizes.collect()) <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(rows, "100")
        corpus_pipeline.encode(spark, docs, SF)
        assert spark.conf.get(rows) == "100"
    finally:
        spark.conf.set(rows, before)


def test_an_encoding_task_leaves_no_encoder_behind(monkeypatch):
    monkeypatch.setattr(bpe, "map_text", lambda *args, setup, **options: setup)
    bpe.encoder.cache_clear()
    bpe.load_ranks.cache_clear()
    many = bpe.encode(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)()
    (ids,), (none,) = many([b"two words", None])
    assert len(ids) and not len(none)
    assert bpe.encoder.cache_info().currsize == bpe.load_ranks.cache_info().currsize == 0
