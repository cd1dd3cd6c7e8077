"""Substring dedup by lines and sentences: the earliest occurrence stays, later ones are cut.

Units are the lines of a text and the sentences within them; white space and
A-Z are normalised, and every line that is not blank is a unit, as is every
sentence; only a caller's option leaves short ones out.  Occurrences of a
digest (128 bits) are ranked by (document id, place), the first one is kept,
whether copies lie in one document or in many.  Map tasks settle copies among
their own rows, so a very frequent unit sends one row per task to the global
grouping, a window over the digest.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import as_bytes
from .substrings import _mark, _pack_texts, cut

CHUNK_UNITS = 400_000
#: Sentence ends that need no white space behind them (a full-width stop between digits is none), and their first bytes.
_HARD = b"|".join(c.encode() for c in "。！？｡؟۔।॥።၊။។៕։") + b"|\xef\xbc\x8e(?!\xef\xbc[\x90-\x99]|[0-9])"
_CLOSERS = b"|".join(c.encode() for c in "」』）】》〉”’")
_LEADS = rb"\xd6\xd8\xdb\xe0\xe1\xe3\xef"
_SENTENCE = re.compile(rb"\S(?:[^.!?" + _LEADS + rb"]++|[.!?]+(?=\S)|(?!" + _HARD + rb")[" + _LEADS + rb"])*+(?:(?:" + _HARD
                       + rb")++(?:" + _CLOSERS + rb")*+|[.!?]*)")
#: A full stop behind these words ends no sentence.
_SHORT = set(b"mr. mrs. ms. dr. prof. st. sr. jr. vs. etc. e.g. i.e. cf. fig. vol. pp. ca. approx. inc. ltd. co.".split())


def _goes_on(line: bytes, start: int, end: int) -> bool:
    """Whether the full stop before ``end`` belongs to an abbreviation, an initial or a list's number."""
    if line[end - 1:end] != b"." or end == len(line):
        return False
    if line[end + 1:end + 2].islower():
        return True
    word = line[max(start, end - 12):end].split()[-1].lower()
    return word in _SHORT or (len(word) == 2 and word[:1].isalpha()) or (word[:-1].isdigit() and end - start == len(word))


def _sentences(line: bytes):
    start = None
    for m in _SENTENCE.finditer(line):
        start, end = m.start() if start is None else start, m.end()
        if not _goes_on(line, start, end):
            yield start, end
            start = None
    if start is not None:
        yield start, end


def units(text: bytes, least_line: int = 1, least_sentence: int = 1):
    """(start, end, normalised bytes) of the units of a text: all lines and sentences of so many normalised bytes."""
    at = 0
    for line in text.split(b"\n"):
        whole = b" ".join(line.lower().split())
        if whole:
            if len(whole) >= least_line:
                yield at, at + len(line), whole
            for s, e in _sentences(line):
                one = b" ".join(line[s:e].lower().split())
                if len(one) >= least_sentence and one != whole:
                    yield at + s, at + e, one
        at += len(line) + 1


def _unit_map(least_line: int, least_sentence: int):
    def out(doc, mark, start, end, high, low):
        cols = [np.array(c, np.int64) for c in (doc, start, end)]
        high, low = np.array(high, np.uint64).view(np.int64), np.array(low, np.uint64).view(np.int64)
        order = np.lexsort((cols[1], cols[0], low, high))
        begins = np.ones(len(order), bool)
        begins[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        first = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        later = np.zeros(len(order), bool)  # a repeated row's unit is at the place of the first one: no later copy
        later[order] = (cols[0][order] != cols[0][first]) | (cols[1][order] != cols[1][first])
        # Settled rows only pass through the grouping: keys of their own spread them.
        high = np.where(later, cols[0] * 0x9E3779B1 + cols[1], high)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(np.array(mark, np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(high),
             pa.array(low), pa.array(later)], ["doc", "mark", "start", "end", "high", "low", "later"])

    def run(batches):
        held = ([], [], [], [], [], [])
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if i is None or not text:
                    continue
                m = _mark(text)
                for s, e, unit in units(text, least_line, least_sentence):
                    h = xxhash.xxh3_128_intdigest(unit)
                    for c, v in zip(held, (i, m, s, e, h >> 64, h & 0xFFFFFFFFFFFFFFFF), strict=True):
                        c.append(v)
                if len(held[0]) > CHUNK_UNITS:
                    yield out(*held)
                    held = ([], [], [], [], [], [])
        if held[0]:
            yield out(*held)
    return run


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_line: int = 1,
            least_sentence: int = 1) -> DataFrame:
    """Units to remove per document: ``doc, mark, places array<struct<start, end>>`` in bytes of the original text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _unit_map(least_line, least_sentence), "doc long, mark int, start long, end long, high long, low long, later boolean")
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("high", "low", "later"))
    late = rows.withColumn("first", first).filter(F.col("later") | (F.struct("doc", "start") != F.col("first")))
    return late.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("places"))


def _merged(places) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in sorted((p["start"], p["end"]) for p in (places if places is not None else ())):
        if out and p[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p[1]))
        else:
            out.append(p)
    return out


def _with_places(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("__null"))
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["row"].dataType.simpleString()
    packed = texts.mapInArrow(_pack_texts, f"row {kind}, doc long, mark int, z binary")
    return packed.join(removed(docs, id_col=id_col, text_col=text_col, **options), ["doc", "mark"], "left")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``id, n_bytes, n_units, n_removed, n_spans, kept_sha256, spans`` (bytes of the original text).

    ``n_units`` counts removed units, ``n_removed`` their bytes.  Null texts
    count as empty; rows with a null id are no source and lose nothing.  Rows
    that share id and text share their result, and their units are one.
    """
    def run(batches):
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for z, places in zip(b.column("z").to_pylist(), b.column("places").to_pylist(), strict=True):
                text, found = zstandard.decompress(z), _merged(places)
                kept = cut(text, found)
                units_cut = len({(p["start"], p["end"]) for p in places or ()})
                rows.append((len(text), units_cut, len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(),
                             [{"start": s, "end": e} for s, e in found]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(
                cols, (pa.int64(),) * 4 + (pa.string(), struct), strict=True)]],
                ["id", "n_bytes", "n_units", "n_removed", "n_spans", "kept_sha256", "spans"])

    got = _with_places(docs.select(id_col, text_col), id_col, text_col, **options)
    id_type = dict(docs.dtypes)[id_col]
    return (got.select(F.col(f"row.`{id_col}`").alias("id"), "z", "places")
               .mapInArrow(run, f"id {id_type}, n_bytes long, n_units long, n_removed long, n_spans long, kept_sha256 string, "
                                "spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col))


@F.pandas_udf(StringType())
def _kept_text(z: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([cut(zstandard.decompress(a), _merged(b)).decode() for a, b in zip(z, places, strict=True)])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with later copies of units cut from the texts, same rows and columns."""
    got = _with_places(docs, id_col, text_col, **options)
    text = F.when(~F.col("row.__null"), _kept_text("z", "places"))
    return got.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
