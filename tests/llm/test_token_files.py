"""Token files: the library's own ids, reading back, ranges, damage."""

import glob

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from wordloom.llm import rans

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", None, "", "one two three " * 30_000, "x<|endoftext|><|endoftext|>", "ünï  cödé\n\n", "one"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "ids")
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rans.write_ids(rans.tokenize(docs, PATH), path)
    tok = Tokenizer.from_file(PATH)
    return path, [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]


def test_added_tokens_keep_their_ids_and_ids_come_back(spark, written):
    path, want = written
    assert 50256 in want[0]
    got = {}
    for r in sorted(rans.read_ids(spark, path).collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("start, n", [(0, 10), (3, 70_000), (60_000, 40_000), (65_536, 1), (0, 10**9), (10**9, 5), (7, 0)])
def test_ranges_decode_between_checkpoints(spark, written, start, n):
    path, want = written
    flat = [i for ids in want for i in ids]
    got = rans.read_range(spark, path, start, n).collect()
    assert [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()] == flat[start:start + n]


def test_a_stretch_ends_at_the_next_checkpoint():
    ids = np.random.default_rng(0).zipf(1.3, 300_000).clip(max=900).astype(np.uint32)
    coder = rans.Coder(rans.quantise(np.bincount(ids, minlength=950), 16), 16)
    lanes, marks, words = coder.encode(ids)
    count = len(marks) // (8 * (2 + lanes))
    assert count > 3
    parts = [coder.decode(len(ids), lanes, marks, words, k, k + 1) for k in range(count)]
    assert (np.concatenate(parts) == ids).all()


def test_damaged_blocks_raise(spark, written, tmp_path):
    path = str(tmp_path / "damaged")
    spark.read.parquet(f"{written[0]}/table").write.parquet(f"{path}/table")
    (tmp_path / "damaged" / "blocks").mkdir()
    for k, f in enumerate(glob.glob(f"{written[0]}/blocks/part-*.parquet")):
        t = pq.read_table(f)
        words = [bytes([w[0] ^ 1]) + w[1:] for w in t["words"].to_pylist()]
        pq.write_table(t.set_column(t.schema.get_field_index("words"), "words", pa.array(words, pa.binary())), f"{path}/blocks/{k}.parquet")
    with pytest.raises(Exception, match="damaged"):
        rans.read_ids(spark, path).collect()


def test_an_empty_table_gives_empty_files(spark, tmp_path):
    path = str(tmp_path / "none")
    rans.write_ids(rans.tokenize(spark.createDataFrame([], "doc_id long, text string"), PATH), path)
    assert rans.read_digests(spark, path).collect() == [] == rans.read_range(spark, path, 0, 5).collect()
