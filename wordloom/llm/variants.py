"""Spelling variants: words of a corpus that differ by one code point, found by blocked Gram matrices.

A word is a vector of letter counts.  Replacing a letter moves it by a squared
distance of two, inserting or deleting one by one, so near words lie in blocks
of one length or of adjacent lengths at a squared distance of at most two.  The
distances of a panel of words come from one matrix product (|x|^2 + |y|^2 - 2xy);
pairs within two are then verified letter by letter.

So that products stay small, the blocks of a length are cut finer without losing
a pair: the alphabet is dealt into four groups, an edit touches the counts of at
most two of them, hence two words that are near agree in the counts of at least
two whole groups.  Each of the six choices of two groups makes a blocking by
these counts, and a pair counts in the first blocking whose counts agree.
Blocks that are still large are cut into tiles, and pairs of tiles are the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blas import single_thread_blas
from ..session import materialize
from .common import as_bytes, slices
from .exchange import runs
from .pieces import groups

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
GROUPS = 4
PAIRS = list(combinations(range(GROUPS), 2))
#: Rows of one product, rows that a block may have before it is cut into tiles, and rows held at once.
PANEL, TILE, HELD = 256, 4096, 32_768
#: Words up to this length are verified in arrays, longer ones one by one.
SHORT = 48


def word_counts(docs: DataFrame, *, least_length: int = 5, least_n: int = 3, thin: int = 97,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: maximal letter runs of whole texts, A-Z lower-cased, with their counts.

    Let h be the crc32 of ``<doc_id>:<run>``: if ``thin`` divides h, the run
    loses its code point h mod length.  Words have at least ``least_length`` code
    points and ``least_n`` occurrences.  A null text has no runs, a null doc_id
    is written as nothing.
    """
    def run(batches):
        letters = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")     # a shorter run can't become a word
        for batch in slices(batches, 4096):
            texts = as_bytes(batch.column(1))
            for first, end in groups(texts):
                total: Counter = Counter()
                for i in range(first, end):
                    if not texts[i]:
                        continue
                    name = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                    for word, n in Counter(letters.findall(texts[i].translate(_LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), name)
                        if h % thin == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                        total[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                                 ["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers of all words end to end, lengths)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes - 97, codes - 0xC0 + 26), np.array([len(w) for w in words], np.int64)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for every word."""
    letters, n = _letters(words)
    row = np.repeat(np.arange(len(words)), n)
    return np.bincount(row * LETTERS + letters, minlength=len(words) * LETTERS).reshape(-1, LETTERS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(counts: np.ndarray) -> np.ndarray:
    """(words, groups): a 64-bit hash of each group's letter counts; letters are dealt to the groups in turn."""
    weight = _mixed(np.arange(1, LETTERS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    c = counts.astype(np.uint64) * weight
    return np.stack([_mixed(c[:, g::GROUPS].sum(axis=1, dtype=np.uint64)) for g in range(GROUPS)], axis=1)


def _blocked(batches):
    """Every word in its blocks: six of its own length, six as the longer word of the length below."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        sig = signatures(letter_counts(words))
        size = np.array([len(w) for w in words], np.int64)
        for role in (0, 1):
            at = np.flatnonzero(size > role)
            for k, (g, h) in enumerate(PAIRS):
                kind = (size[at] - role) * len(PAIRS) + k
                block = _mixed(sig[at, g] * np.uint64(3) + sig[at, h] * np.uint64(5) + kind.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(np.full(len(at), role, np.int8)),
                     batch.column("word").take(pa.array(at)), batch.column("n").take(pa.array(at))],
                    ["block", "kind", "role", "word", "n"])


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Words with their blocks, tiles and pairs of tiles.

    ``first`` and ``second`` name the pair of tiles a row stands for, ``tile`` the
    word's own.  A block of up to ``tile`` rows is one tile.
    """
    rows = words.mapInArrow(_blocked, "block long, kind int, role byte, word string, n long")
    large = rows.groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    tiles = F.ceil(F.coalesce("size", F.lit(1)) / tile).cast("int")
    cut = rows.join(large, "block", "left").withColumn("tiles", tiles).withColumn(
        "tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    return (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
               .select("block", "kind", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
                       "role", "tile", "word", "n"))


def one_edit(x: str, y: str) -> bool:
    """Whether one replaced code point makes x of y, or one more code point makes y of x."""
    at = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x != y and (x[at + 1:] == y[at + 1:] if len(x) == len(y) else x[at:] == y[at + 1:])


def _verified(words: list[str], letters: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j), j as long as i or one longer, are one edit apart."""
    ok = np.zeros(len(i), bool)
    short = size[j] <= SHORT
    for k in np.flatnonzero(~short).tolist():
        ok[k] = one_edit(words[i[k]], words[j[k]])
    at = np.flatnonzero(short)
    x, y = letters[i[at]], letters[j[at]]
    differ = x != y
    shift = x[:, :-1] != y[:, 1:]
    lead = np.argmax(differ, axis=1)           # behind the first difference y is x moved by one
    moved = (shift & (np.arange(SHORT) >= lead[:, None])).any(axis=1)
    ok[at] = np.where(size[i[at]] == size[j[at]], differ.sum(axis=1) == 1, ~moved)
    return ok


def _near(held: dict) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j) of whole blocks, held as sorted rows."""
    words, role, tile = held["word"], held["role"], held["tile"]
    counts = letter_counts(words)
    sig = signatures(counts)
    letter, size = _letters(words)
    letters = np.full((len(words), SHORT + 1), 255, np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    letters[row[place < SHORT], place[place < SHORT]] = letter[place < SHORT]
    x = counts.astype(np.float32)
    norm = (x * x).sum(axis=1)
    start = runs(held["block"], held["kind"], held["first"], held["second"])
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(words))))
    end = np.append(start[1:], len(words))
    whole = held["first"] == held["second"]
    found = []
    for s in range(0, len(words), PANEL):
        e = min(s + PANEL, len(words))
        stop = int(end[group[e - 1]])
        for c in range(s, stop, 8 * PANEL):
            d = min(c + 8 * PANEL, stop)
            squared = norm[s:e, None] + norm[None, c:d] - 2 * (x[s:e] @ x[c:d].T)
            i, j = np.nonzero((squared < 2.5) & (group[s:e, None] == group[None, c:d]))
            i, j = i + s, j + c
            # Rows of a block: shorter words first, so that j is never shorter than i.
            good = (j > i) & (role[i] == 0) & (whole[i] | (tile[i] != tile[j]))
            i, j = i[good], j[good]
            same = sig[i] == sig[j]
            first = np.argmax(np.stack([same[:, g] & same[:, h] for g, h in PAIRS], axis=1), axis=1)
            good = first == held["kind"][i] % len(PAIRS)
            found.append((i[good], j[good]))
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    ok = _verified(words, letters, size, i, j)
    return i[ok], j[ok]


def _links(batches):
    """(word, other, other_n) for both words of every near pair of a task's sorted blocks."""
    names = ["block", "kind", "first", "second", "role", "tile", "n"]
    single_thread_blas()
    held: dict = {}

    def solve(rows):
        if not len(rows["word"]):
            return
        i, j = _near(rows)
        if len(i):
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            word = pa.array(rows["word"], pa.string())
            yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), pa.array(rows["n"][b])],
                                             ["word", "other", "other_n"])

    for batch in batches:
        got = {k: batch.column(k).to_numpy() for k in names} | {"word": batch.column("word").to_pylist()}
        held = {k: np.concatenate([held[k], got[k]]) if k in names else held[k] + got[k] for k in got} if held else got
        if len(held["word"]) >= HELD:
            start = runs(held["block"], held["kind"], held["first"], held["second"])
            at = int(start[-1])                # the last block may go on in the next batch
            yield from solve({k: v[:at] for k, v in held.items()})
            held = {k: v[at:] for k, v in held.items()}
    if held:
        yield from solve(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, other, other_n``: every pair of words one edit apart, from both sides."""
    keys = ["block", "kind", "first", "second"]
    dealt = blocks(words, tile).repartition(*keys).sortWithinPartitions(*keys, "role")
    return dealt.mapInArrow(_links, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of every word's chain of forms (``word, form``), by doubling the steps.

    A form has at least twice its word's count, so chains are no longer than the
    counts' binary logarithm, and the number of rounds is that one's logarithm.
    """
    chain = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while chain.filter("moved").limit(1).count():
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        chain = materialize(chain.join(step, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
    return chain.select("word", "root")


def group_variants(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n`` of distinct words.

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if that
    is at least twice the word's, ``root`` the end of the chain of forms, the word itself
    without one.  Words consist of a-z and U+00C0 to U+00FF.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    has = F.col("best").isNotNull() & (-F.col("best.less") >= 2 * F.col("n"))
    out = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    ends = roots(out.filter(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
