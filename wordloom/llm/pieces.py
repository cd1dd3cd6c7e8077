"""Whole texts as rows of distinct pieces, cut where no tokenizer token crosses.

A group of texts is one byte buffer; its cuts are found in arrays, equal pieces
are made one by Arrow's dictionary encoding, and only pieces that a bounded memo
does not hold go to the tokenizer library.  A text's value is then the
concatenation of its pieces' values, gathered by code.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut and encoded together.
GROUP_BYTES = 6_000_000

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks that end a word; the apostrophe is none, as it may open a contraction.
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?)]}\"")] = True


def white_space(buf: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes belong to characters of Unicode's White_Space."""
    ws = _ASCII_SPACE[buf]
    if len(buf) < 2 or buf.max() < 0xC2:
        return ws
    lead = np.flatnonzero(buf[:-1] == 0xC2)
    lead = lead[np.isin(buf[lead + 1], (0x85, 0xA0))]
    ws[lead] = ws[lead + 1] = True
    for first, second, last in ((0xE1, 0x9A, [0x80]), (0xE2, 0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]),
                                (0xE2, 0x81, [0x9F]), (0xE3, 0x80, [0x80])):
        at = np.flatnonzero(buf[:-2] == first)
        at = at[(buf[at + 1] == second) & np.isin(buf[at + 2], last)]
        ws[at] = ws[at + 1] = ws[at + 2] = True
    return ws


def byte_level_cuts(buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where matches of the byte-level pre-tokenizer pattern begin for sure.

    ``edge[i]`` says that a text starts at byte i.  White space starts a match
    where a run of it starts; the run's last character goes with what follows
    if it is a blank, and alone if it is another ASCII one.  A mark after an
    ASCII letter starts a match too.
    """
    ws = white_space(buf)
    cut = edge.copy()
    cut[1:] |= ws[1:] & ~ws[:-1]
    cut[1:] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    last = np.flatnonzero(ws[:-1] & ~ws[1:] & ~edge[1:])
    last = last[buf[last] < 0x80]
    cut[last] = True
    cut[last[buf[last] != 32] + 1] = True
    return cut


def blank_cuts(buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Blanks after a character that is no white space: neither byte-level nor piece tokens cross them."""
    ws = white_space(buf)
    cut = edge.copy()
    cut[1:] |= (buf[1:] == 32) & ~ws[:-1]
    return cut


class Pieces:
    """Codes of whole texts' pieces, and the values of the distinct ones.

    ``make_many(pieces) -> values`` gets distinct pieces (bytes).  Values met
    before come from a memo of about ``limit`` entries in two generations: when
    the young one is full it becomes the old one, values asked for again move
    back, the others are forgotten.  Forgetting only costs time.  ``atoms`` are
    strings that a text is always cut around and never inside.
    """

    def __init__(self, make_many: Callable[[list[bytes]], list], cuts=byte_level_cuts, atoms: tuple[bytes, ...] = (),
                 limit: int = 400_000):
        self.make_many, self.cuts, self.atoms, self.half = make_many, cuts, atoms, limit // 2
        self.young, self.old = {}, {}

    def _values(self, pieces: list[bytes]) -> list:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                value = old.get(p)
                if value is None:
                    new.append(p)
                else:
                    young[p] = value
        if new:
            young.update(zip(new, self.make_many(new), strict=True))
        return [young[p] for p in pieces]

    def _atoms(self, data: bytes, edge: np.ndarray) -> list[tuple[int, int]]:
        """Places of atoms inside one text, from left to right."""
        found = []
        for atom in self.atoms:
            at = data.find(atom)
            while at >= 0:
                if not edge[at + 1:at + len(atom)].any():
                    found.append((at, at + len(atom)))
                    at = data.find(atom, at + len(atom))
                else:
                    at = data.find(atom, at + 1)
        return sorted(found)

    def group(self, texts: list[bytes]) -> tuple[list[bytes], list, np.ndarray, np.ndarray]:
        """(distinct pieces, their values, codes of all pieces, first code of every text and the end)."""
        data = b"".join(texts)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        if not data:
            return [], [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        buf = np.frombuffer(data, np.uint8)
        edge = np.zeros(len(buf), bool)
        edge[starts[:-1][starts[:-1] < len(buf)]] = True
        atoms = self._atoms(data, edge)
        for a, b in atoms:
            edge[a] = True
            if b < len(buf):
                edge[b] = True
        cut = self.cuts(buf, edge)
        for a, b in atoms:
            cut[a + 1:b] = False
        offsets = np.append(np.flatnonzero(cut), len(buf)).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = found.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        return pieces, self._values(pieces), coded.indices.to_numpy().astype(np.int64), np.searchsorted(offsets, starts)


def groups(texts: list, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``size`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held > size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def gather(values: list[bytes] | pa.Array, codes: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Values of all pieces end to end, and the byte where every text starts (and the end)."""
    if not len(codes):
        return memoryview(b""), np.zeros(len(bounds), np.int64)
    taken = (values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())).take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1)
    return memoryview(taken.buffers()[2] or b""), at[bounds]


class Library:
    """Ids of pieces by the tokenizers library; ``plain`` takes added tokens' strings as ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.added = () if plain else tuple(sorted(t.content.encode() for t in self.tok.get_added_tokens_decoder().values()))
        vocab = self.tok.get_vocab()
        self.width = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        # A byte-level token has a character for every byte.
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]

    def encode(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, counts): the k-th run of ``counts[k]`` ids belongs to ``pieces[order[k]]``.

        A word's end and the next blank are cut apart anyway, so pieces of a
        blank and a word go to the library end to end, a hundred in a text;
        the bytes of the tokens tell where each piece ends.
        """
        texts = [p.decode() for p in pieces]
        joined = [i for i, t in enumerate(texts) if t[0] == " " and not (t[-1].isspace() or t[1].isspace())]
        got = []
        for k in range(0, len(joined), 10_000):
            part = joined[k:k + 10_000]
            some = ["".join([texts[i] for i in part[j:j + 100]]) for j in range(0, len(part), 100)]
            got += [one.ids for one in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable(got)), self.width)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[i]) for i in joined])) + 1
        if len(joined) == len(pieces):
            return joined, ids, np.diff(ends, prepend=0)
        taken = set(joined)
        rest = [i for i in range(len(pieces)) if i not in taken]
        more = [self.tok.encode(texts[i], add_special_tokens=False).ids for i in rest]
        return (joined + rest, np.concatenate([ids, np.array(list(chain.from_iterable(more)), self.width)]),
                np.concatenate([np.diff(ends, prepend=0), [len(x) for x in more]]).astype(np.int64))


@lru_cache(maxsize=2)
def library_ids(path: str) -> tuple[Pieces, np.dtype]:
    """Pieces whose values are their ids by the tokenizers library, as the library's defaults give them.

    Added tokens are atoms: their strings in a text become their own ids.
    """
    library = Library(path)

    def make_many(pieces):
        out: list = [b""] * len(pieces)
        order, ids, counts = library.encode(pieces)
        raw = ids.tobytes()
        at = 0
        for i, to in zip(order, (np.cumsum(counts) * ids.itemsize).tolist(), strict=True):
            out[i] = raw[at:to]
            at = to
        return out

    return Pieces(make_many, byte_level_cuts, library.added, limit=700_000), library.width


def text_ids(path: str, texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, first id of every text and the end) for groups of texts; null is empty."""
    pieces, width = library_ids(path)
    for first, end in groups(texts):
        _, values, codes, bounds = pieces.group([t or b"" for t in texts[first:end]])
        flat, at = gather(values, codes, bounds)
        yield first, np.frombuffer(flat, width), at // width.itemsize
