"""Token-id files: interleaved static rANS blocks with checkpoints and checksums.

File format (a folder, written by Spark)::

    table/   symbol int, freq int       frequencies over the whole corpus, sum 2**bits
    blocks/  shard int, block int       shards follow each other in doc_id order
             first long                 ids of the shard before this block
             doc_ids array<long>        documents with ids here, in order
             ords array<long>           their ordinals in the shard
             pieces array<int>          0, or the piece's number if a document spans blocks
             lens array<int>            their ids here
             lanes int                  interleaved states
             marks binary               checkpoints: row, word offset, state of each lane
             words binary               32-bit code words
             words_crc, ids_crc long    crc32 of the code words, and of the ids as little-endian u32

A block never needs another one, and its lanes are stepped together by numpy.
Decoding may start at any checkpoint: it has all lane states and the offset of
the next code word.  A state is a 64-bit number in [2**31, 2**63).
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import checkpoint_dir
from .common import as_bytes, slices
from .pieces import text_ids

LOW = np.uint64(1 << 31)
BLOCK_IDS, LANES, MARK_ROWS = 1 << 18, 1024, 64
BLOCKS = ("shard int, block int, first long, doc_ids array<long>, ords array<long>, pieces array<int>, "
          "lens array<int>, lanes int, marks binary, words binary, words_crc long, ids_crc long")


def quantise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies with sum 2**bits, at least 1 for every symbol that occurs."""
    counts = counts.astype(np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    room = (1 << bits) - int(seen.sum())
    if room < 0:
        raise ValueError("more symbols than slots")
    freq = np.where(seen, 1 + np.floor(counts * room / counts.sum()), 0).astype(np.int64)
    freq[np.argmax(freq)] += (1 << bits) - freq.sum()
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[int, bytes, bytes]:
        """lanes, marks, words of one block."""
        lanes = max(1, min(LANES, len(ids) // 16))
        f, c, lim = self.freq[ids], self.cum[ids], self.limit[ids]
        state = np.full(lanes, LOW)
        rows = -(-len(ids) // lanes)
        words, marks, behind = [], [], 0
        shift, half = np.uint64(self.bits), np.uint64(32)
        for row in range(rows - 1, -1, -1):
            at = slice(row * lanes, min(len(ids), (row + 1) * lanes))
            fr = f[at]
            x = state[:len(fr)]
            over = x >= lim[at]
            w = x[over].astype("<u4")
            x = np.where(over, x >> half, x)
            q = x // fr
            state[:len(fr)] = (q << shift) + (x - q * fr) + c[at]
            words.append(w)
            behind += len(w)
            if row % MARK_ROWS == 0:
                marks.append((row, behind, state.copy()))
        packed = b"".join(np.array([row, behind - left], "<u8").tobytes() + s.astype("<u8").tobytes()
                          for row, left, s in reversed(marks))
        return lanes, packed, b"".join(w.tobytes() for w in reversed(words))

    def decode(self, n: int, lanes: int, marks: bytes, words: bytes, mark: int = 0, stop: int | None = None) -> np.ndarray:
        """The block's ids from checkpoint ``mark`` on, up to checkpoint ``stop`` or the block's end."""
        if not n:
            return np.zeros(0, np.uint32)
        head = np.frombuffer(marks, "<u8").reshape(-1, 2 + lanes)[mark]
        start, at = int(head[0]), int(head[1])
        state, code = head[2:].astype(np.uint64), np.frombuffer(words, "<u4")
        rows = -(-n // lanes)
        if stop is not None and stop < len(marks) // (8 * (2 + lanes)):
            rows = int(np.frombuffer(marks, "<u8").reshape(-1, 2 + lanes)[stop][0])
        out = np.empty((rows - start) * lanes, np.uint32)
        mask, shift, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32)
        for row in range(start, rows):
            k = min(lanes, n - row * lanes)
            x = state[:k]
            slot = x & mask
            sym = self.symbol[slot]
            x = self.freq[sym] * (x >> shift) + slot - self.cum[sym]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << half) | code[at:at + len(low)]
            at += len(low)
            state[:k] = x
            out[(row - start) * lanes:(row - start) * lanes + k] = sym
        return out[:n - start * lanes]


def tokenize(docs: DataFrame, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, symbols, width``: ids of every text with ``end_id`` appended, and histograms.

    ``ids`` are little-endian numbers of ``width`` bytes, as the library gives
    them for the whole text: the strings of added tokens become their own ids.
    Each task ends with a row whose ``symbols`` holds the counts of all ids it
    made (little-endian u64 by id; bounded by the vocabulary) and no ids.
    """
    def run(batches):
        total, width = np.zeros(0, np.int64), None
        for b in slices(batches, 2048):
            for at, ids, edges in text_ids(path, as_bytes(b.column(1))):
                width = ids.dtype
                end = np.array([end_id], width).tobytes()
                raw = [ids[i:j].tobytes() + end for i, j in zip(edges[:-1], edges[1:], strict=True)]
                one = np.bincount(ids, minlength=max(len(total), end_id + 1))
                one[:len(total)] += total
                one[end_id] += len(raw)
                total = one
                n = len(raw)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(raw, pa.binary()), pa.nulls(n, pa.binary()),
                                                  pa.array([width.itemsize] * n, pa.int32())], _TOKENS)
        if len(total):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<u8").tobytes()], pa.binary()),
                 pa.array([width.itemsize], pa.int32())], _TOKENS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")) \
               .mapInArrow(run, _TOKEN_SCHEMA)


_TOKENS = ["doc_id", "ids", "symbols", "width"]
_TOKEN_SCHEMA = "doc_id long, ids binary, symbols binary, width int"


def _histogram(batches):
    """(symbol, n) rows of one task's histograms."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column(0):
            one = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
            if len(one) < len(total):
                one, total = total, one
            one = one.copy()
            one[:len(total)] += total
            total = one
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["symbol", "n"])


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write the rows of :func:`tokenize` as a folder of rANS blocks.

    The rows are stored once.  Their histograms are summed in the executors
    (rows bounded by the vocabulary); then a sort by doc_id makes the shards,
    whose blocks are coded one by one.  Documents longer than a block are cut, so memory is bounded by a
    block and the longest text.  Ties in doc_id are ordered by their ids, null
    ids come first; an empty table gives an empty folder.
    """
    spark = tokens.sparkSession
    store = f"{path}/tokens"
    tokens.write.option("compression", "zstd").parquet(store)
    tokens = spark.read.schema(_TOKEN_SCHEMA).parquet(store)
    counts = (tokens.filter(F.col("symbols").isNotNull()).select("symbols").mapInArrow(_histogram, "symbol int, n long")
                    .groupBy("symbol").agg(F.sum("n").alias("n")).toPandas())
    by_symbol = np.zeros(int(counts["symbol"].max()) + 1 if len(counts) else 0, np.int64)
    by_symbol[counts["symbol"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    bits = max(16, int(len(counts)).bit_length() + 2)
    freq = quantise(by_symbol, bits)
    table = pd.DataFrame({"symbol": np.arange(len(freq), dtype=np.int32), "freq": freq.astype(np.int32)})
    spark.createDataFrame(table, "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table")

    def shard(batches):
        coder, no = Coder(freq, bits), TaskContext.get().partitionId()
        block, first, ordinal = 0, 0, 0
        held, rows, size = [], [], 0

        def flush():
            nonlocal block, first, held, rows, size
            ids = np.concatenate(held)
            lanes, marks, words = coder.encode(ids)
            d, o, p, k = zip(*rows, strict=True)
            row = {"shard": no, "block": block, "first": first, "doc_ids": d, "ords": o, "pieces": p, "lens": k,
                   "lanes": lanes, "marks": marks, "words": words, "words_crc": zlib.crc32(words),
                   "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}
            block, first, held, rows, size = block + 1, first + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), _BLOCK_TYPES, strict=True)],
                                              list(row))

        for b in batches:
            for doc, raw, width in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                for piece, at in enumerate(range(0, len(ids), BLOCK_IDS)):
                    part = ids[at:at + BLOCK_IDS]
                    if size and size + len(part) > BLOCK_IDS:
                        yield flush()
                    held.append(part.copy())
                    rows.append((doc, ordinal, piece, len(part)))
                    size += len(part)
                ordinal += 1
        if size:
            yield flush()

    # The sort samples its keys, so it must not start from the texts again: it reads the stored ids.
    (tokens.filter(F.col("ids").isNotNull()).select("doc_id", "ids", "width").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
           .mapInArrow(shard, BLOCKS).write.parquet(f"{path}/blocks"))


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    table = spark.read.schema("symbol int, freq int").parquet(f"{path}/table").toPandas().sort_values("symbol")
    freq = table["freq"].to_numpy(np.int64)
    bits = max(1, int(freq.sum()).bit_length() - 1)
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), freq, bits


def read_pieces(spark: SparkSession, path: str, what: str = "ids") -> DataFrame:
    """Decode every block: ``shard, ord, piece, doc_id, first, n`` and the piece's ids or their crc32.

    Both checksums of each block are verified; a damaged block raises.
    """
    blocks, freq, bits = _blocks(spark, path)

    def run(batches):
        coder = Coder(freq, bits)
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            if zlib.crc32(r["words"]) != r["words_crc"]:
                raise ValueError(f"damaged code words in shard {r['shard']}, block {r['block']}")
            raw = coder.decode(sum(r["lens"]), r["lanes"], r["marks"], r["words"]).astype("<u4").tobytes()
            if zlib.crc32(raw) != r["ids_crc"]:
                raise ValueError(f"damaged ids in shard {r['shard']}, block {r['block']}")
            ends = np.cumsum(r["lens"]) * 4
            parts = [raw[e - 4 * k:e] for e, k in zip(ends, r["lens"], strict=True)]
            n = len(parts)
            value = pa.array(parts, pa.binary()) if what == "ids" else pa.array([zlib.crc32(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array(r["ords"], pa.int64()), pa.array(r["pieces"], pa.int32()),
                 pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + ends // 4 - np.array(r["lens"]), pa.int64()),
                 pa.array(r["lens"], pa.int64()), value],
                ["shard", "ord", "piece", "doc_id", "first", "n", what])

    kind = "binary" if what == "ids" else "long"
    return blocks.mapInArrow(run, f"shard int, ord long, piece int, doc_id long, first long, n long, {what} {kind}")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, shard_start``: ids of all shards before it (one row per shard: bounded by the shuffle partitions)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    n = blocks.select("shard", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sums = n.groupBy("shard").agg(F.sum("n").alias("n")).toPandas().sort_values("shard")
    start = np.concatenate([[0], np.cumsum(sums["n"].to_numpy(np.int64))])[:-1].astype(np.int64) if len(sums) else []
    return spark.createDataFrame(pd.DataFrame({"shard": sums["shard"].astype("int32"), "shard_start": start}),
                                 "shard int, shard_start long")


def crc32_combine(a: int, b: int, n: int) -> int:
    """crc32 of two strings' concatenation from theirs, the second one ``n`` bytes long.

    Appending a zero byte is a linear map on the 32 bits; its n-th power comes
    from squaring.
    """
    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    byte = one_bit
    for _ in range(3):
        byte = [times(byte, v) for v in byte]
    while n:
        if n & 1:
            a = times(byte, a)
        byte, n = [times(byte, v) for v in byte], n >> 1
    return a ^ b


@F.pandas_udf(LongType())
def _joined_crc(pieces: pd.Series) -> pd.Series:
    def one(rows):
        total = 0
        for i, r in enumerate(rows):
            total = r["crc"] if i == 0 else crc32_combine(total, r["crc"], 4 * r["n"])
        return total
    return pieces.map(one)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    parts = read_pieces(spark, path, "crc")
    docs = parts.groupBy("shard", "ord").agg(
        F.min("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece", "crc", "n"))).alias("pieces"))
    return (docs.join(F.broadcast(shard_starts(spark, path)), "shard")
                .select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens",
                        _joined_crc("pieces").alias("ids_crc32")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, piece, start, ids`` (little-endian u32) in pieces of at most a block."""
    return (read_pieces(spark, path).join(F.broadcast(shard_starts(spark, path)), "shard")
            .select("doc_id", "piece", (F.col("shard_start") + F.col("first")).alias("start"), "ids"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """``start, ids`` (little-endian u32) of the file's ids ``start`` to ``start + n``, in the order of ``start``'s values.

    Only the blocks of that range are read, and each is cut at its checkpoints:
    a row of work is the stretch between two of them, so that tasks share a
    block.  The code words' checksum is verified; the ids' one is the whole
    block's and is left to :func:`read_pieces`.
    """
    blocks, freq, bits = _blocks(spark, path)
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    here = (blocks.join(F.broadcast(shard_starts(spark, path)), "shard")
                  .select((F.col("shard_start") + F.col("first")).alias("at"), size.alias("size"), "lanes", "marks", "words", "words_crc")
                  .filter((F.col("at") < start + n) & (F.col("at") + F.col("size") > start)))
    count = F.floor(F.length("marks") / (8 * (2 + F.col("lanes")))).cast("int")
    work = here.withColumn("mark", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("at") + F.col("mark").cast("long") * MARK_ROWS * F.col("lanes")
    work = work.filter((first < start + n) & (first + F.col("lanes") * MARK_ROWS > start)).repartition("at", "mark")

    def run(batches):
        coder = Coder(freq, bits)
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            if zlib.crc32(r["words"]) != r["words_crc"]:
                raise ValueError(f"damaged code words in the block from id {r['at']}")
            ids = coder.decode(r["size"], r["lanes"], r["marks"], r["words"], r["mark"], r["mark"] + 1).astype("<u4")
            at = r["at"] + r["mark"] * MARK_ROWS * r["lanes"]
            low, high = max(start - at, 0), min(start + n - at, len(ids))
            if low < high:
                yield pa.RecordBatch.from_arrays([pa.array([at + low]), pa.array([ids[low:high].tobytes()], pa.binary())], ["start", "ids"])

    return work.mapInArrow(run, "start long, ids binary").orderBy("start")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
