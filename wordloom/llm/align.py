"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

Tokens and bytes make an incidence matrix in CSR form: row i has a one for every
byte of token i.  With A and B of two tokenizations, the entries of A.B' are the
pairs of tokens that share bytes, and with their token-by-group matrices the
entries of Ga.Gb' are the pairs that lie in one group.  Both products are made
row by row (Gustavson): a row of the result gathers the rows of the right matrix
that its entries name.

A blank after a character that is no white space starts a token of either
tokenizer, so texts are cut there, and every distinct piece is aligned once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import as_bytes, releasing, slices
from .exchange import runs
from .pieces import Library, Pieces, blank_cuts, gather, groups


class Csr:
    """A sparse matrix of ones: row i's columns are ``columns[starts[i]:starts[i + 1]]``, ascending."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @classmethod
    def of_spans(cls, ends: np.ndarray) -> Csr:
        """Row i has the columns from the end of row i - 1 up to ``ends[i]``."""
        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(width), width)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Row i has the one column ``labels[i]``."""
        return cls(np.arange(len(labels) + 1), labels, width)

    @property
    def rows(self) -> np.ndarray:
        """Row of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]).astype(np.int64)
        return Csr(starts, self.rows[order], len(self.starts) - 1)

    def times(self, right: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product's entries, by row and column.

        Every entry (i, k) brings row k of ``right`` into row i; equal columns of a row are added up.
        """
        n = np.diff(right.starts)[self.columns]
        row = np.repeat(self.rows, n)
        first = np.repeat(right.starts[self.columns], n)
        column = right.columns[first + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        at = runs(row, column)
        return row[at], column[at], np.diff(np.append(at, len(row)))


def _byte_of() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _pieces(a_path: str, b_path: str) -> Pieces:
    """Aligned pieces; every one begins with a blank, or with the start of its text's blank.

    A value is ``(n_a, n_b, n_groups, n_links, n_shared, links, groups)``: ``links`` has
    the ids of every overlapping pair, ``a << 16 | b`` as little-endian u32,
    ``groups`` is ``a1,a2|b1;a3|b2;``.  A piece whose bytes one of the tokenizers
    does not give back has the value None.
    """
    import sentencepiece

    library = Library(a_path, plain=True)
    a = library.tok
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte_of = _byte_of()
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())]
    if any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in b_bytes):
        raise ValueError("the second vocabulary has pieces that cross a blank")
    if max(len(a_bytes), len(b_bytes)) > 1 << 16:
        raise ValueError("pairs of ids take 16 bits each")
    blank = b.piece_to_id("▁")
    sides = Side(a_bytes, "|"), Side(b_bytes, ";")

    def some(pieces):
        """Values of pieces; B itself puts a blank before what it gets."""
        order, x, x_n = library.encode(pieces)
        pieces = [pieces[i] for i in order]
        got = [ids if p != b" " else [blank] for p, ids in zip(pieces, b.encode([p[1:].decode() for p in pieces], num_threads=1), strict=True)]
        y, y_n = np.array(list(chain.from_iterable(got)), np.int64), np.array([len(ids) for ids in got], np.int64)
        x = x.astype(np.int64)
        good = sides[0].gives_back(pieces, x, x_n) & sides[1].gives_back(pieces, y, y_n)
        out: list = [None] * len(pieces)
        if good.any():
            x, y = x[np.repeat(good, x_n)], y[np.repeat(good, y_n)]
            kept = [order[k] for k in np.flatnonzero(good).tolist()]
            for i, value in zip(kept, _aligned(x, x_n[good], y, y_n[good], *sides), strict=True):
                out[i] = value
        return out

    def make_many(pieces):
        return [value for at in range(0, len(pieces), 10_000) for value in some(pieces[at:at + 10_000])]

    return Pieces(make_many, blank_cuts, limit=120_000)


class Side:
    """Bytes of a tokenizer's tokens, and their ids as text before a comma or before ``last``."""

    def __init__(self, token_bytes: list[bytes], last: str):
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        n = range(len(token_bytes))
        self.texts = pa.array([f"{i},".encode() for i in n] + [f"{i}{last}".encode() for i in n], pa.large_binary())

    def gives_back(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which pieces the tokens' bytes make up."""
        flat, at = gather(self.bytes, ids, np.concatenate([[0], np.cumsum(counts)]))
        whole = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        if np.array_equal(at[1:], ends) and flat == whole:
            return np.ones(len(pieces), bool)
        return np.array([bytes(flat[i:j]) == p for p, i, j in zip(pieces, at[:-1], at[1:], strict=True)])


def _aligned(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray, a_side: Side, b_side: Side) -> list[tuple]:
    """Values of pieces, all aligned by one product over their bytes end to end."""
    a_end, b_end = np.cumsum(a_side.lengths[a]), np.cumsum(b_side.lengths[b])
    a_row, b_row, _ = Csr.of_spans(a_end).times(Csr.of_spans(b_end).transposed())
    # A group ends where tokens of both end.
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    s_row, _, _ = Csr.of_labels(a_group, len(ends)).times(Csr.of_labels(b_group, len(ends)).transposed())
    a_edge, b_edge = (np.concatenate([[0], np.cumsum(n)]) for n in (a_n, b_n))
    link_edge = np.searchsorted(a_row, a_edge)
    groups_ = np.diff(np.concatenate([[0], a_group[a_edge[1:] - 1] + 1]))
    shared = np.diff(np.searchsorted(s_row, a_edge))
    pairs = (a[a_row].astype("<u4") << np.uint32(16) | b[b_row].astype("<u4")).tobytes()
    # Texts of the groups: A's ids, then B's, each group's last ones with their own marks.
    place = np.empty(len(a) + len(b), np.int64)
    a_last, b_last = np.append(np.diff(a_group) > 0, True), np.append(np.diff(b_group) > 0, True)
    place[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + a_last * len(a_side.bytes)
    place[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = (b + b_last * len(b_side.bytes)) + len(a_side.texts)
    both = pa.concat_arrays([a_side.texts, b_side.texts])
    text, at = gather(both, place, a_edge + b_edge)
    text = bytes(text)
    columns = (a_n.tolist(), b_n.tolist(), groups_.tolist(), np.diff(link_edge).tolist(), shared.tolist(),
               (4 * link_edge[:-1]).tolist(), (4 * link_edge[1:]).tolist(), at[:-1].tolist(), at[1:].tolist())
    return [(n, m, g, k, s, pairs[p:q], text[i:j]) for n, m, g, k, s, p, q, i, j in zip(*columns, strict=True)]


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
#: One row for a group of documents: their digests, the codes of their pieces and the pieces' links.
ALIGNED = ("doc_ids array<long>, sizes array<int>, counts array<array<long>>, groups_sha256 array<string>, "
           "codes binary, links binary, link_counts binary")


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents, a row for a group of them (see :data:`ALIGNED`).

    A is a byte-level tokenizer that gets a blank and the text, B one that puts
    the blank there itself.  A text that is null or empty, or that one of them
    does not give back byte by byte, has no tokens.  Rows with one doc_id are
    documents of their own.  ``codes`` (u32) name the pieces of the group's
    documents, ``sizes`` how many each has; piece k has ``link_counts[k]`` (u32)
    of the pairs in ``links`` (u32).
    """
    def run(batches):
        pieces = _pieces(a_path, b_path)
        for b in slices(batches, 512):
            texts = [b" " + t if t else b"" for t in as_bytes(b.column(1))]
            for first, end in groups(texts, 2_000_000):
                _, values, codes, bounds = pieces.group(texts[first:end])
                lost = np.array([v is None for v in values], bool)
                if lost.any():                 # documents with such a piece have no tokens
                    bad = np.concatenate([[0], np.cumsum(lost[codes])])
                    bad = bad[bounds[1:]] > bad[bounds[:-1]]
                    kept = ~np.repeat(bad, np.diff(bounds))
                    codes = codes[kept]
                    bounds = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(bounds)))])
                    values = [v or (0, 0, 0, 0, 0, b"", b"") for v in values]
                counts = [_sums(np.array([v[k] for v in values], np.int64), codes, bounds) for k in range(len(_COUNTS))]
                text, at = gather([v[6] for v in values], codes, bounds)
                shas = [hashlib.sha256(text[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]
                row = {"doc_ids": b.column(0).slice(first, end - first).to_pylist(), "sizes": np.diff(bounds).tolist(),
                       "counts": [c.tolist() for c in counts], "groups_sha256": shas, "codes": codes.astype("<u4").tobytes(),
                       "links": b"".join(v[5] for v in values),
                       "link_counts": np.array([v[3] for v in values], np.int64).astype("<u4").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_ALIGNED)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), ALIGNED)


_ALIGNED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                      ("counts", pa.list_(pa.list_(pa.int64()))), ("groups_sha256", pa.list_(pa.string())),
                      ("codes", pa.binary()), ("links", pa.binary()), ("link_counts", pa.binary())])


def _sums(values: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the pieces' values between the bounds."""
    total = np.concatenate([[0], np.cumsum(values[codes])]) if len(codes) else np.zeros(1, np.int64)
    return np.diff(total[bounds])


def _row_arrays(batch: pa.RecordBatch, i: int):
    column = lambda name: batch.column(name)[i].as_buffer()
    return (np.frombuffer(column("codes"), "<u4"), np.frombuffer(column("links"), "<u4"),
            np.frombuffer(column("link_counts"), "<u4").astype(np.int64))


def _pair_counts(batches):
    """(pair, n) of a task: links are counted by distinct piece, then added up over the task's groups."""
    held, size = [], 0

    def merged():
        """What is held, one entry for each pair."""
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, inverse = np.unique(keys, return_inverse=True)
        return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint32(16)).astype(np.int64)),
                                           pa.array((keys & np.uint32(0xFFFF)).astype(np.int64)), pa.array(n)], ["a", "b", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            codes, links, counts = _row_arrays(batch, i)
            times = np.bincount(codes, minlength=len(counts))
            held.append((links, np.repeat(times, counts)))
            size += len(links)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:           # Spark adds up what does not fit
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: links of every id pair in the corpus; ``best`` if no pair of its B id has more."""
    n = (aligned.select("codes", "links", "link_counts").mapInArrow(releasing(_pair_counts), "a long, b long, n long")
                .groupBy("a", "b").agg(F.sum("n").alias("n")))
    n = materialize(n)
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


#: Largest part of the pair table that is broadcast at once, in rows (17 bytes each).
BROADCAST_PAIRS = 4_000_000


def score(aligned: DataFrame, pairs: DataFrame, max_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row per document: its counts, ``groups_sha256``, ``n_best`` and ``count_sum``.

    The pair table's size depends on the two vocabularies.  It is broadcast if it
    has at most ``max_pairs`` rows; otherwise parts of about that many rows, cut
    by a hash of the B id, are broadcast one after the other, each adds up the
    links it knows, and the parts' sums are added.
    """
    spark = aligned.sparkSession
    size = pairs.count()
    parts = max(1, -(-size // max_pairs))
    table = pairs.select((F.shiftleft("a", 16) + F.col("b")).alias("pair"), "n", "best")
    if parts == 1:
        return _scored(aligned, _shared(spark, table), 0)
    table = table.withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(parts)))
    done = None
    for k in range(parts):
        one = _scored(aligned, _shared(spark, table.filter(F.col("part") == k).drop("part")), k)
        done = one if done is None else done.unionByName(one)
    # A document is known by its row's place; all its counts but two are alike in every part.
    return done.groupBy("place", "doc_id", *_COUNTS, "groups_sha256").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _shared(spark, table: DataFrame):
    got = table.toArrow()
    keys, n, best = (got.column(i).to_numpy() for i in range(3))
    order = np.argsort(keys)
    return spark.sparkContext.broadcast((keys[order].astype(np.uint32), n[order], best[order]))


def _scored(aligned: DataFrame, shared, part: int) -> DataFrame:
    def run(batches):
        keys, n, best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                codes, links, link_counts = _row_arrays(batch, i)
                n_best, sums = _link_sums(links, np.cumsum(link_counts), keys, n, best)
                sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                counts = batch.column("counts")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{batch.column('place')[i].as_py()}:{k}" for k in range(len(sizes))], pa.string()),
                     pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array(batch.column("groups_sha256")[i].as_py(), pa.string()),
                     pa.array(_sums(n_best, codes, bounds)), pa.array(_sums(sums, codes, bounds))],
                    ["place", "doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum"])

    schema = f"place string, doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(releasing(run), schema)


def _link_sums(links, ends, keys, n, best) -> tuple[np.ndarray, np.ndarray]:
    """Per piece: its links that are the best of their B id, and the sum of its links' counts."""
    out = []
    if len(keys):
        at = np.searchsorted(keys, links)
        known = at < len(keys)
        known[known] = keys[at[known]] == links[known]
        at = np.where(known, at, 0)
        values = (best[at] & known, np.where(known, n[at], 0))
    else:
        values = (np.zeros(len(links), np.int64),) * 2
    for v in values:
        total = np.concatenate([[0], np.cumsum(v.astype(np.int64))])[np.concatenate([[0], ends])]
        out.append(np.diff(total))
    return out[0], out[1]


def report(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text",
           max_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256``.

    ``n_links`` are the pairs of tokens that overlap, ``n_shared`` those in one
    group, ``n_best`` the links whose pair no other pair of the same B id beats in
    the corpus, ``count_sum`` the sum of the links' corpus-wide counts.
    """
    aligned = materialize(align(docs, a_path, b_path, id_col=id_col, text_col=text_col)
                          .withColumn("place", F.monotonically_increasing_id()))
    return score(aligned, materialize(pair_counts(aligned)), max_pairs).drop("place")
