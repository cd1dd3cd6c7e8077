"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of a task's rows.  Words that no benchmark item holds cannot
lie in an occurrence, so a shard's index covers its maximal runs of benchmark
words that are long enough for a window.  The index is the Burrows-Wheeler
transform of the runs in a wavelet matrix; all windows are searched backwards
at once, and their places come from sampled suffix positions by LF steps.

The benchmark goes to the tasks in blocks of bounded size (``block_words``);
texts are passed through once for each block, without a shuffle, and written
between blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import alnum_words, as_bytes, slices

WINDOW = 10
SAMPLE = 16
#: As ``alnum_words``, for places in the bytes of a text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be smaller than all and unique."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    s = seq[order]
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    k = 1
    while k < n:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.before, self.zeros, cur = [], [], seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.before.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(cur) - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``i``, for arrays of both."""
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in enumerate(zip(self.before, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Over runs of symbols >= 1; ``find`` gives all places of many patterns."""

    def __init__(self, runs: np.ndarray, starts: np.ndarray, symbols: int):
        """``runs``: runs each ended by 0; ``starts``: where runs start."""
        # Ends of runs are told apart while sorting, so that a suffix's order is settled within its run.
        ends = np.flatnonzero(runs == 0)
        keyed = runs.astype(np.int64) + len(ends)
        keyed[ends] = np.arange(len(ends), 0, -1) - 1
        sa = suffix_array(keyed)
        self.bwt = runs[sa - 1].astype(np.int64)  # of the first suffix: the last end
        self.wave = WaveletMatrix(self.bwt, symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(runs, minlength=symbols))]).astype(np.int64)
        keep = np.zeros(len(runs), bool)
        keep[::SAMPLE] = True
        keep[starts] = True
        kept = keep[sa]
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places = kept, sa[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that start with each pattern (rows of equal length)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.bwt), np.int64)
        for c in patterns.T[::-1]:
            lo = self.less[c] + self.wave.rank(c, lo)
            hi = self.less[c] + self.wave.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the runs of the suffixes in these rows."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.places[self.kept_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at]
            at = self.less[c] + self.wave.rank(c, at)
            steps += 1
        return out

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place) of every occurrence."""
        lo, hi = self.ranges(patterns)
        n = hi - lo
        which = np.repeat(np.arange(len(patterns)), n)
        rows = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.locate(rows)


class Benchmark:
    """Windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in alnum_words(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if ids else 0):
                holders = by_length.setdefault(k, {}).setdefault(tuple(ids[i:i + k]), set())
                if item is not None:  # its windows count as hits, but it has no id to report
                    holders.add(item)
        self.windows = {k: (np.array(list(v), np.int64), [sorted(x) for x in v.values()]) for k, v in by_length.items()}
        self.least = min(self.windows, default=0)

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each text (words): merged spans (start, end) in words, and the items found."""
        get, n = self.words.get, [len(t) for t in texts]
        offset = np.cumsum([0] + [k + 1 for k in n])
        ids = np.zeros(offset[-1] + 1, np.int64)
        for t, k, o in zip(texts, n, offset, strict=False):
            ids[o:o + k] = np.fromiter(map(get, t, repeat(0)), np.int64, k)
        out = [([], set()) for _ in texts]
        if not self.least:
            return out
        inside = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        edge = np.diff(inside)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= self.least
        a, b = a[long], b[long]
        if not len(a):
            return out
        size = b - a + 1
        starts = np.cumsum(size) - size
        at = np.repeat(a - starts, size) + np.arange(size.sum())
        runs = ids[at]  # each run with the 0 behind it
        index = FMIndex(runs, starts, len(self.words) + 1)
        hits = []
        for k, (patterns, items) in self.windows.items():
            which, place = index.find(patterns)
            place = at[place]
            doc = np.searchsorted(offset, place, "right") - 1
            hits.append((doc, place - offset[doc], np.full(len(doc), k)))
            for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                out[d][1].update(items[w])
        doc, start, k = (np.concatenate(x) for x in zip(*hits, strict=True))
        for i in np.lexsort((start, doc)):
            spans, s, e = out[doc[i]][0], int(start[i]), int(start[i] + k[i])
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> tuple[int, Iterator[Benchmark]]:
    """How many blocks the benchmark's measured size makes, and the blocks, each fetched when it is asked for."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(size // (2 * block_words)) + 1  # a word and its separator: two characters at least

    def block(k: int) -> Benchmark:
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        return Benchmark([(r[0], r[1].encode() if r[1] is not None else None) for r in part.toLocalIterator()], window)

    return n, map(block, range(n))


def _shards(batches, rows: int, size: int = 8 << 20):
    """Slices of at most ``rows`` rows, and of ``size`` bytes of text where they hold more than one row."""
    for b in slices(batches, rows):
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("__text")), 0).to_numpy().astype(np.int64))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + size, "right")))
            yield b.slice(first, last - first)
            first = last


_SPANS = "spans array<struct<first:int,last:int>>, items array<string>"


def search(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = 1_000_000,
           shard_rows: int = 2048, keep_text: bool = False, cut_text: bool = False) -> DataFrame:
    """Occurrences of benchmark windows: one row per input row.

    ``id, n_words, spans, items[, text]``: merged spans of words (first, last
    inclusive) and the sorted ids of the items with an occurring window.  An
    item of fewer than ``window`` words, but not none, is one window.  Null
    texts have no words, null items none either; an item without an id hits
    words but is not among the items.  Repeated rows repeat results.
    With ``cut_text`` the text comes without its spans.
    """
    id_type = dict(docs.dtypes)[id_col]
    cur = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"),
                      F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col, window, block_words)
    struct = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for k, block in enumerate(blocks):
        cutting = cut_text and k + 1 == n_blocks
        text_out = keep_text or cut_text or k + 1 < n_blocks

        def run(batches, block=block, text_out=text_out, cutting=cutting):
            for b in _shards(batches, shard_rows):
                raw, kept = as_bytes(b.column("__text")), b.column("__text")
                texts = [alnum_words(t) for t in raw]
                found = block.search(texts)
                old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
                spans, items = [], []
                for at, ((s, i), (so, io)) in enumerate(zip(found, old, strict=True)):
                    if so:
                        s = _merge(s + [(x["first"], x["last"] + 1) for x in so])
                    if cutting and s:
                        raw[at] = cut(raw[at], s)
                    spans.append([{"first": a, "last": e - 1} for a, e in s])
                    items.append(sorted({*i, *io}))
                cols = [b.column("__id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, struct),
                        pa.array(items, pa.list_(pa.string()))]
                names = ["__id", "n_words", "spans", "items"]
                if cutting and any(spans):
                    kept = pa.array(raw, pa.binary()).cast(kept.type)
                yield pa.RecordBatch.from_arrays(cols + [kept] * text_out, names + ["__text"] * text_out)

        cur = cur.mapInArrow(run, f"__id {id_type}, n_words long, {_SPANS}" + ", __text string" * text_out)
        if k + 1 < n_blocks:  # a task and the driver hold one block at a time
            cur = materialize(cur)
    extra = [F.col("__text").alias("text")] if keep_text or cut_text else []
    return cur.select(F.col("__id").alias(id_col), "n_words", "spans", "items", *extra)


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Digest of :func:`search`: counts, the items' sha256 and the verdict of each document."""
    def run(batches):
        for b in batches:
            ids = ["," .join(i) for i in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in (0, 1, 2, 3)], pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids])],
                [id_col, "n_words", "n_hit", "n_items", "items_sha256"])

    found = search(docs, benchmark, id_col=id_col, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    id_type = dict(docs.dtypes)[id_col]
    return (found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
                 .mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items_sha256 string")
                 .withColumn("contaminated", F.col("n_hit") > 0))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans of words (start, end), each from its first to its last word's bytes."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all spans removed from the texts; other columns, rows and texts without a span stay."""
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols if c != text_col], F.lit(0).alias("__some"))
    packed = docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__t"))
    found = search(packed, benchmark, id_col="__row", text_col="__t", cut_text=True, **options)
    return found.select(*[(F.col("text") if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in cols])
