"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z:
#: every ASCII byte that is neither a digit nor a letter becomes a blank.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

#: White space of the Unicode property, as the tokenizer libraries have it
#: (``re``'s own ``\s`` also holds U+001C..U+001F).
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between the white space ``[\\x20\\x09-\\x0D]`` of UTF-8 bytes."""
    return text.split() if text else []


#: Pieces that every byte-level pre-tokenizer pattern of this package keeps
#: apart: a run without white space with the blank before it, and white space.
#: A match of the full pattern never crosses their edges.
COARSE = re.compile(f" ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+")


class Pieced:
    """Values of whole texts, concatenated from those of their coarse pieces.

    ``make_many(pieces) -> values (bytes)`` gets sorted pieces.  Values of
    pieces met before come from a memo of about ``limit`` entries: when half of
    that is full it becomes the old generation, values asked for again move
    back from there, the others are forgotten.  Forgetting only costs time.
    """

    def __init__(self, make_many: Callable[[list[str]], list[bytes]], limit: int = 500_000):
        self.make_many, self.half, self.young, self.old = make_many, limit // 2, {}, {}

    def _values(self, pieces: set[str]) -> dict[str, bytes]:
        """Values of distinct pieces.  Letters and a final comma or full stop are two matches of any pattern."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new, ends = set(), []
        for p in pieces.difference(young):
            value = old.get(p)
            if value is not None:
                young[p] = value
            elif p[-1] in ",." and (p[1:-1] if p[0] == " " else p[:-1]).isalpha():
                ends.append(p)
                new.add(p[:-1])
                new.add(p[-1])
            else:
                new.add(p)
        made = sorted(new.difference(young))
        young.update(zip(made, self.make_many(made), strict=True))
        for p in ends:
            young[p] = young[p[:-1]] + young[p[-1]]
        return {p: young[p] for p in pieces}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken in groups, so that a group's distinct pieces are looked up once."""
        group, size = [], 0
        for t in [*texts, None]:
            if t is not None:
                group.append(t)
                size += len(t)
            if group and (t is None or size > 3_000_000):
                cut = [COARSE.findall(x) for x in group]
                value = self._values(set().union(*cut)).__getitem__
                for pieces in cut:
                    yield b"".join(map(value, pieces))
                group, size = [], 0


def as_bytes(column: pa.Array) -> list:
    """Python bytes (or None) of a string column, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving the memory that it has freed back to the system when a task ends.

    Workers outlive their tasks; what the allocators keep would otherwise count
    beside the JVM's memory while other stages run.
    """
    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # the GNU C library has it
        if trim:
            trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(docs: DataFrame, fn: Callable[[bytes | None], tuple] | None, schema: dict[str, str], *,
             id_col: str = "doc_id", text_col: str = "text", setup: Callable | None = None) -> DataFrame:
    """One row ``(id, *fn(text))`` for every row of ``docs``, in Arrow batches.

    ``schema`` names fn's results and their Spark types.  With ``setup``, a
    function from a list of texts to their rows is made in every task instead.
    Only the two columns are read, so other columns may have any name.
    """
    id_type = dict(docs.dtypes)[id_col]
    out = f"`{id_col}` {id_type}, " + ", ".join(f"{k} {v}" for k, v in schema.items())
    types = [_ARROW[v] for v in schema.values()]
    names = [id_col, *schema]

    def run(batches):
        many = setup() if setup else lambda texts: [fn(t) for t in texts]
        for batch in slices(batches, 2048):
            rows = list(many(as_bytes(batch.column(1))))
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(releasing(run), out)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
