"""Substring dedup by grouped windows: remove bytes of long strings that an earlier document has.

Every byte covered by a ``WIN``-byte string that also starts in a document with
a smaller id is removed.  Grouped windows stand in for a suffix array; none is
built, nor common prefixes or longest previous factors beyond ``WIN`` bytes:

1. *Anchors.*  In each window of ``WIN`` bytes the gram with the smallest hash
   is chosen, so equal windows choose equal grams at equal places.  An anchor's
   context is the stretch of all windows that may have chosen it.
2. *Equal contexts* (the inside of copies).  Of the anchors with one gram and
   one context the smallest id stays, the context is covered in all others.
   Map tasks do this among their own anchors first, so a group of copies sends
   one record per task.
3. *Different contexts of one gram* (edges of copies, edits).  Two contexts
   share a window only if the bytes that they share before the gram and behind
   it are ``REACH`` together, so on one side they share half of that.  Hashes of
   these halves tell which contexts have such a partner; grams that agree by
   chance, of which a growing corpus has ever more, go no further.  The others'
   contexts are fetched from their first documents and cut into their windows, which are
   sorted as strings of ``WIN`` bytes; a window is covered if a smaller document
   is in its group of equal ones.  Of a gram with very many contexts, stretches
   of a few windows are routed by the bytes that all of these hold.
4. The covered stretches are merged per document and cut out.

Contexts are compared by 104 bits of hashes (40 of the gram, 64 of the context,
which holds the gram's bytes).  Grams that agree in 40 bits only cost a comparison.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialize
from .common import as_bytes, releasing
from .exchange import pack, parts_for, runs, unpack, unpack_all

WIN, GRAM = 50, 16
REACH = WIN - GRAM                      # a window starts at most so far before its anchor
HALF = REACH // 2                       # two contexts with a common window share so many bytes before or behind the gram
SEGMENT, MARGIN = 1 << 18, 2 * WIN      # bytes hashed at once, and what is read around them
CHUNK = 2 << 20                         # bytes of text whose anchors are combined in a map task
HOT = 4096                              # contexts of one gram, beyond which they are routed in stretches
STRETCHES = ((0, 8), (9, HALF), (HALF + 1, 26), (27, REACH))  # windows that go together then, by how many bytes before the gram they start
BLOCK = 2048                            # contexts sorted at once
ROWS = 1 << 18                          # windows of one group sorted at once
PASSES = 4                              # parts of a task's grams that are unpacked one after the other
KEY = (1 << 40) - 1                     # bits of a gram's hash that are sent
U = np.uint64


def _loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as a number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every stretch of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    v = _loads(buf)
    h = v[:-8] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += v[8:]
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xC2B2AE3D27D4EB4F)
    return h


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) chosen by any window of the buffer; ties are all chosen."""
    if len(buf) < WIN:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = gram_hashes(buf)
    small = (h >> U(32)).astype(np.uint32)
    least = _sliding(np.minimum, small, REACH + 1)
    edge = np.zeros(REACH, np.uint32)
    most = _sliding(np.maximum, np.concatenate([edge, least, edge]), REACH + 1)
    at = np.flatnonzero(most == small)
    return at, h[at]


def context_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of ``buf[at - REACH:at + WIN]``."""
    v = _loads(buf)
    c = np.zeros(len(at), U)
    for shift in (*range(-REACH, WIN - 8, 8), WIN - 8):
        c ^= v[at + shift]
        c *= U(0x9FB21C651E98DF25)
        c ^= c >> U(31)
    return c


def half_hashes(buf: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ``HALF`` bytes before each gram (low 16 bits) and behind it (the 16 above), 0 where the text ends before.

    ``begin`` and ``end`` are those of the anchors' texts.
    """
    v = _loads(buf)
    out = np.zeros(len(at), U)
    for low, full, first in ((0, at - HALF >= begin, -HALF), (16, at + GRAM + HALF <= end, GRAM)):
        place = at[full] + first
        h = np.zeros(len(place), U)
        for shift in (*range(0, HALF - 8, 8), HALF - 8):
            h ^= v[place + shift]
            h *= U(0x9FB21C651E98DF25)
            h ^= h >> U(31)
        out[full] |= np.maximum(h >> U(48), U(1)) << U(low)
    return out


def text_anchors(buf: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, gram hash, context hash) for texts end to end in ``buf``.

    Works on segments with a margin, so memory does not follow a text's length.
    """
    ends = np.cumsum(lens)
    begins, out = ends - lens, []
    for lo in range(0, len(buf), SEGMENT):
        a, b = max(0, lo - MARGIN), min(len(buf), lo + SEGMENT + MARGIN)
        part = buf[a:b]
        at, g = anchors(part)
        mine = (at + a >= lo) & (at + a < lo + SEGMENT)
        at, g = at[mine] + a, g[mine]
        text = np.searchsorted(ends, at, "right")
        inside = (at + GRAM <= ends[text]) & (lens[text] >= WIN)
        at, g, text = at[inside], g[inside], text[inside]
        full = (at - REACH >= begins[text]) & (at + WIN <= ends[text])
        c = np.zeros(len(at), U)
        c[full] = context_hashes(buf, at[full])
        for i in np.flatnonzero(~full):
            s, e = max(begins[text[i]], at[i] - REACH), min(ends[text[i]], at[i] + WIN)
            c[i] = xxhash.xxh64_intdigest(buf[s:e].tobytes(), int(at[i] - s) << 8 | int(e - at[i]))
        out.append((text, at - begins[text], g, c))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2


def _mark(text: bytes) -> int:
    """24 bits of a text's hash: rows that share an id but not the text stay apart."""
    return xxhash.xxh64_intdigest(text) & 0xFFFFFF


def _chunks(batches):
    """(ids, texts) of at most about CHUNK bytes; rows without id or with short texts left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            for i, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                if i is not None and t is not None and len(t) >= WIN:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
            if size > CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _groups(gram, context, doc):
    """Order by (gram, context, id), starts of the (gram, context) groups, and each record's group's smallest id."""
    order = np.lexsort((doc, context, gram))
    g, c, d = gram[order], context[order], doc[order]
    start = runs(g, c)
    size = np.diff(np.append(start, len(g)))
    return order, start, np.repeat(d[start], size)


_ROUTED = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("mark", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
_ROUTED_SQL = "part int, doc long, mark int, kind string, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROUTED, strict=True)],
                                      schema=_ROUTED)


def _per_doc(doc: np.ndarray, mark: np.ndarray, kind: str, columns: list[np.ndarray]):
    """Rows with one document's records each."""
    order = np.lexsort((mark, doc))
    start = np.append(runs(doc[order], mark[order]), len(doc))
    for a, b in zip(start, start[1:], strict=False):
        i = order[a:b]
        yield (None, int(doc[i[0]]), int(mark[i[0]]), kind, pack([c[i] for c in columns]))


def _pack_anchors(gram, context, text, pos, ids, marks, *halves) -> bytes:
    """Records in the order of their texts: ids and marks once for a text, then whether a record begins one."""
    used, index = np.unique(text, return_inverse=True)
    head = pack([ids[used], marks[used]])
    return len(head).to_bytes(8, "little") + head + pack([gram, context, np.diff(index, prepend=0), pos, *halves])


def _unpack_anchors(blob: bytes) -> list[np.ndarray]:
    """gram, context, doc[, halves], and place with the mark above 40 bits, of :func:`_pack_anchors`."""
    k = int.from_bytes(blob[:8], "little")
    ids, marks = (c.view(np.int64) for c in unpack(blob[8:8 + k]))
    gram, context, step, pos, *halves = unpack(blob[8 + k:])
    index = np.cumsum(step.view(np.int64))
    return [gram, context, ids[index], *halves, pos | marks.view(U)[index] << U(40)]


def _anchor_map(parts: int):
    def run(batches):
        for ids, texts in _chunks(batches):
            doc_ids, marks = np.array(ids, np.int64), np.array([_mark(t) for t in texts], np.int64)
            buf = np.frombuffer(b"".join(texts), np.uint8)
            lens = np.array([len(t) for t in texts], np.int64)
            text, pos, gram, context = text_anchors(buf, lens)
            gram &= U(KEY)
            doc, mark = doc_ids[text], marks[text]
            order, _, first = _groups(gram, context, doc)
            later = np.zeros(len(doc), bool)
            later[order] = doc[order] > first
            rows = list(_per_doc(doc[later], mark[later], "covered", [pos[later]]))
            k = np.flatnonzero(~later)
            part = ((gram[k] >> U(8)) % U(parts)).astype(np.int64)
            k, edges = k[np.argsort(part, kind="stable")], np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
            ends = np.cumsum(lens)
            begins = ends - lens
            halves = np.zeros(len(gram), U)
            halves[k] = half_hashes(buf, begins[text[k]] + pos[k], begins[text[k]], ends[text[k]])
            rows += [(p, None, None, "anchors", _pack_anchors(gram[i], context[i], text[i], pos[i], doc_ids, marks, halves[i]))
                     for p in range(parts) if len(i := k[edges[p]:edges[p + 1]])]
            for at in range(0, len(rows), 2000):
                yield _rows(rows[at:at + 2000])
    return run


def _pass_on(batches, kinds: tuple[str, ...], keep: list):
    """Rows of other kinds go on as they are; those of ``kinds`` are gathered."""
    for b in batches:
        kind = b.column("kind").to_pylist()
        data = b.column("data")
        keep += [data[i].as_py() for i, k in enumerate(kind) if k in kinds]
        rest = pa.array([k not in kinds for k in kind])
        if any(k not in kinds for k in kind):
            yield b.filter(rest)


def _partnered(gram: np.ndarray, halves: np.ndarray, head: np.ndarray) -> np.ndarray:
    """On which sides (1 before, 2 behind) a context shares its gram's half with one that another document has first."""
    out = np.zeros(len(gram), np.int64)
    for side, low in ((1, 0), (2, 16)):
        half = halves >> U(low) & U(0xFFFF)
        k = np.flatnonzero(half)
        k = k[np.lexsort((half[k], gram[k]))]
        if len(k):
            start = runs(gram[k], half[k])
            several = np.minimum.reduceat(head[k], start) != np.maximum.reduceat(head[k], start)
            out[k] |= np.repeat(np.where(several, side, 0), np.diff(np.append(start, len(k))))
    return out


def _settled(gram, context, doc, halves, place):
    """Columns (doc, mark, place) of the covered anchors, and (doc, mark, place, gram, sides) of those to ask for.

    ``sides``: those with a partner, and 4 for a gram with very many such contexts.
    """
    order, start, first = _groups(gram, context, doc)
    g, d = gram[order], doc[order]
    place = place[order]
    pos, mark = (place & U((1 << 40) - 1)).view(np.int64), (place >> U(40)).view(np.int64)
    later = d > first
    # Grams with several contexts, not all of them first seen in one document.
    by_gram = runs(g[start])
    contexts = np.diff(np.append(by_gram, len(start)))
    heads = d[start]
    mixed = np.repeat((contexts > 1) & (np.minimum.reduceat(heads, by_gram) != np.maximum.reduceat(heads, by_gram)), contexts)
    sides = np.zeros(len(start), np.int64)
    sides[mixed] = _partnered(g[start[mixed]], halves[order[start[mixed]]], heads[mixed])
    hot = np.repeat(np.add.reduceat((sides > 0).astype(np.int64), by_gram) > HOT, contexts)
    sides[hot & (sides > 0)] |= 4
    sides = np.repeat(sides, np.diff(np.append(start, len(g))))
    asked = (sides > 0) & ~later
    return ((d[later], mark[later], pos[later]),
            (d[asked], mark[asked], pos[asked], g[asked], sides[asked]))


def _anchor_reduce(batches):
    got: list = []
    yield from _pass_on(batches, ("anchors",), got)
    # A part of the grams at a time: only the packed records are held whole.
    covered, asked = [], []
    for k in range(PASSES):
        some = []
        for blob in got:
            columns = _unpack_anchors(blob)
            mine = columns[0] % U(PASSES) == k
            if mine.any():
                some.append([c[mine] for c in columns])
        if some:
            columns = [np.concatenate(c) for c in zip(*some, strict=True)]
            some.clear()
            a, b = _settled(*columns)
            covered.append(a)
            asked.append(b)
    del got
    if not any(len(c[0]) for c in covered + asked):
        yield pa.RecordBatch.from_pylist([], _ROUTED)
        return
    for kind, found in (("covered", covered), ("asked", asked)):
        if found:
            doc, mark, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
            rows = _per_doc(doc, mark, kind, columns)
            while some := list(islice(rows, 2000)):
                yield _rows(some)


def _stretches(text: bytes, pos: np.ndarray, gram: np.ndarray, sides: np.ndarray):
    """(key, start, length, hash) of what is routed for a text's anchors; the hash is 0 for contexts of a gram's own key.

    A window that starts ``o`` bytes before the gram has a partner only if the
    contexts share ``o`` bytes before the gram and ``REACH - o`` behind it.
    """
    low = np.maximum(np.where(sides & 2, 0, HALF + 1), pos + WIN - len(text))
    high = np.minimum(np.where(sides & 1, REACH, HALF), pos)
    cool = (sides < 4) & (low <= high)
    out = [(gram[cool], pos[cool] - high[cool], WIN + high[cool] - low[cool], np.zeros(cool.sum(), U))]
    for k, (a, b) in enumerate(STRETCHES):
        some = (sides >= 4) & (np.maximum(low, a) <= np.minimum(high, b))
        if some.any():
            p, start, length = pos[some], pos[some] - np.minimum(high[some], b), WIN + np.minimum(high[some], b) - np.maximum(low[some], a)
            # every window of the stretch holds these bytes, whichever of them a text has
            key = [xxhash.xxh64_intdigest(text[x - a:x - b + WIN], k) for x in p.tolist()]
            whole = [xxhash.xxh64_intdigest(text[x:x + n], n << 8 | k) or 1 for x, n in zip(start.tolist(), length.tolist(), strict=True)]
            out.append((np.array(key, U), start, length, np.array(whole, U)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _context_map(parts: int):
    """Contexts (or, of hot grams, stretches of them) of the asked anchors, routed by gram (by content)."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            cols = [[], [], [], [], [], [], []]  # key, doc, mark, start, length, hash, which text
            texts = []
            for doc, mark, z, asked in zip(*(b.column(c).to_pylist() for c in ("doc", "mark", "z", "asked")), strict=True):
                text = zstandard.decompress(z)
                pos, gram, sides = unpack_all(asked)
                key, start, length, whole = _stretches(text, pos.view(np.int64), gram, sides.view(np.int64))
                for c, v in zip(cols, (key, np.full(len(key), doc), np.full(len(key), mark), start, length, whole,
                                       np.full(len(key), len(texts))), strict=True):
                    c.append(v)
                texts.append(text)
            if not texts:
                continue
            gram, doc, mark, start, length, whole, which = (np.concatenate(c) for c in cols)
            # Of equal stretches, a batch sends the first document's and settles the others itself.
            single = np.flatnonzero(whole)
            order = single[np.lexsort((doc[single], whole[single], gram[single]))]
            heads = runs(gram[order], whole[order])
            later = order[np.repeat(doc[order[heads]], np.diff(np.append(heads, len(order)))) < doc[order]]
            n = length[later] - WIN + 1
            windows = np.repeat(start[later], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = list(_per_doc(np.repeat(doc[later], n), np.repeat(mark[later], n), "windows", [windows]))
            keep = np.ones(len(gram), bool)
            keep[later] = False
            gram, doc, mark, start, length, which = (c[keep] for c in (gram, doc, mark, start, length, which))
            part = ((gram >> U(8)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[edges[p]:edges[p + 1]]
                if len(at):
                    data = b"".join(texts[t][s:s + n] for t, s, n in zip(which[at].tolist(), start[at].tolist(), length[at].tolist(), strict=True))
                    head = pack([gram[at], doc[at], mark[at], start[at], length[at]])
                    rows.append((p, None, None, "contexts", len(head).to_bytes(8, "little") + head + press.compress(data)))
            for at in range(0, len(rows), 500):
                yield _rows(rows[at:at + 500])
    return run


def longest_previous(order: np.ndarray, common: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """Whether each string shares ``least`` bytes with one of smaller rank.

    ``order``: sorted order; ``common``: bytes shared with the string before in
    that order (callers may cut it at ``least``); ``rank``: the order of texts.
    That is so iff the stretch of the order in which neighbours share that many
    bytes holds a smaller rank.
    """
    new = np.ones(len(order), bool)
    new[1:] = common[1:] < least
    start = np.flatnonzero(new)
    r = rank[order]
    smallest = np.repeat(np.minimum.reduceat(r, start), np.diff(np.append(start, len(r)))) if len(r) else r
    out = np.zeros(len(order), bool)
    out[order] = smallest < r
    return out


def covered_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of the windows of contexts ``data[start:start + length]`` that an earlier document has."""
    n = length - WIN + 1
    record = np.repeat(np.arange(len(start)), n)
    offset = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    parts = -(-len(record) // ROWS)
    if parts > 1:
        # Equal windows have equal ends, by which they are dealt out and sorted one part after the other.
        v, at = _loads(data), start[record] + offset
        ends = (v[at] * U(0x9E3779B97F4A7C15)) ^ v[at + WIN - 8]
        ends *= U(0x9FB21C651E98DF25)
        part = (ends >> U(32)) % U(parts)
        del ends, at
        found = [_covered(data, start, doc, record[mine], offset[mine]) for p in range(parts) if len(mine := np.flatnonzero(part == U(p)))]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))
    return _covered(data, start, doc, record, offset)


def _covered(data: np.ndarray, start: np.ndarray, doc: np.ndarray, record: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.lib.stride_tricks.sliding_window_view(data, WIN)[start[record] + offset]
    keys = np.ascontiguousarray(rows).view(f"S{WIN}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    same = rows[order]
    equal = np.zeros(len(order), np.int64)
    equal[1:] = np.where((same[1:] == same[:-1]).all(1), WIN, 0)
    hit = longest_previous(order, equal, doc[record], WIN)
    return record[hit], offset[hit]


def _context_reduce(batches):
    got: list = []
    yield from _pass_on(batches, ("contexts",), got)
    if not got:
        return
    heads, texts = [], []
    for blob in got:
        k = int.from_bytes(blob[:8], "little")
        heads.append(blob[8:8 + k])
        texts.append(np.frombuffer(zstandard.decompress(blob[8 + k:]), np.uint8))
    del got
    gram, doc, mark, place, length = (c.view(np.int64) for c in unpack_all(heads))
    data = np.concatenate(texts)
    del texts, heads
    start = np.cumsum(length) - length
    order = np.argsort(gram, kind="stable")
    group = np.append(runs(gram[order]), len(order))
    # Blocks of whole groups: equal windows have equal grams.
    lo = 0
    while lo < len(order):
        hi = int(group[min(len(group) - 1, max(np.searchsorted(group, lo + BLOCK, "right") - 1, np.searchsorted(group, lo, "right")))])
        at = order[lo:hi]
        record, offset = covered_windows(data, start[at], length[at], doc[at])
        record, lo = at[record], hi
        rows = list(_per_doc(doc[record], mark[record], "windows", [place[record] + offset]))
        for i in range(0, len(rows), 2000):
            yield _rows(rows[i:i + 2000])


def _spans(kinds: list[str], blobs: list, size: int) -> list[tuple[int, int]]:
    """Merged covered stretches of one text."""
    if not kinds:
        return []
    starts, ends = [], []
    for kind, blob in zip(kinds, blobs, strict=True):
        (pos,) = unpack(blob)
        pos = pos.view(np.int64)
        starts.append(np.maximum(0, pos - REACH) if kind == "covered" else pos)
        ends.append(np.minimum(size, pos + WIN))
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def _pack_texts(batches):
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = [t or b"" for t in as_bytes(part.column("text"))]
            ids = part.column("doc").to_pylist()
            # A row without id gets a mark that no other row has a record for.
            marks = [_mark(t) if i is not None else -1 - _mark(t) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc").fill_null(0), pa.array(marks, pa.int32()),
                 pa.array([press.compress(t) for t in texts], pa.binary())], ["row", "doc", "mark", "z"])


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns but the text), packed text ``z`` (null for a null text) and covered ``places`` (kind, data).

    Both joins read the same packed texts by the same keys, so that Spark shuffles them once.  Nothing may
    filter or prune one of the two: the keys are never null, and ``row`` goes along.
    """
    parts = parts_for(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = materialize(base.mapInArrow(releasing(_anchor_map(parts)), _ROUTED_SQL)
                            .repartition(parts, F.coalesce("part", F.pmod(F.hash("doc"), F.lit(parts))))
                            .mapInArrow(releasing(_anchor_reduce), _ROUTED_SQL))
    asked = (found.filter(F.col("kind") == "asked").groupBy("doc", "mark").agg(F.collect_list("data").alias("asked")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("__null"))
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["row"].dataType.simpleString()
    packed = texts.mapInArrow(releasing(_pack_texts), f"row {kind}, doc long not null, mark int not null, z binary")
    windows = (packed.join(asked, ["doc", "mark"]).select("row", "doc", "mark", "z", "asked")
                     .mapInArrow(releasing(_context_map(parts)), _ROUTED_SQL)
                     .repartition(parts, F.coalesce("part", F.pmod(F.hash("doc"), F.lit(parts))))
                     .mapInArrow(releasing(_context_reduce), _ROUTED_SQL))
    places = (found.filter(F.col("kind") == "covered").unionByName(windows).groupBy("doc", "mark")
                   .agg(F.collect_list(F.struct("kind", "data")).alias("places")))
    return packed.join(places, ["doc", "mark"], "left")


def _finish(batches, out):
    for b in batches:
        rows = []
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            for z, places in zip(part.column("z").to_pylist(), part.column("places").to_pylist(), strict=True):
                text = zstandard.decompress(z)
                found = _spans([p["kind"] for p in places or ()], [p["data"] for p in places or ()], len(text))
                rows.append(out(text, found))
        yield b, rows


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (start, end in bytes).

    Null texts count as empty.  Rows with a null id are never a source and lose
    nothing.  Repeated rows get the same result; rows that share an id are not
    earlier than each other.
    """
    def digest(text, found):
        kept = cut(text, found)
        return len(text), len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in found]

    def run(batches):
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b, rows in _finish(batches, digest):
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("row").flatten()[0], *[pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), struct), strict=True)]],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    got = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    id_type = dict(docs.dtypes)[id_col]
    return (got.select("row", "z", "places")
               .mapInArrow(releasing(run), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                "spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of long strings cut from the texts, same rows and columns.

    A cut may leave part of a character's bytes; such bytes are dropped from the text.
    """
    def kept(text, found):
        return (cut(text, found).decode(errors="ignore"),)

    def run(batches):
        for b, rows in _finish(batches, kept):
            *fields, null = b.column("row").flatten()
            text = pa.array([None if n else t for (t,), n in zip(rows, null.to_pylist(), strict=True)], pa.string())
            fields = iter(fields)
            yield pa.RecordBatch.from_arrays([text if c == text_col else next(fields) for c in docs_columns], docs_columns)

    docs_columns = docs.columns
    schema = StructType([StructField(c.name, StringType() if c.name == text_col else c.dataType) for c in docs.schema])
    return _with_spans(docs, id_col, text_col).select("row", "z", "places").mapInArrow(releasing(run), schema)
