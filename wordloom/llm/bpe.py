"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoding has exactly one last token.  A
token ``t`` that ends the prefix is that token iff the last token ``u`` of the
prefix without ``t`` and ``t`` can stand side by side, that is iff encoding
``u + t`` gives ``[u, t]`` again.  So one pass over a string stores one token
for each prefix; the encoding is read from the end.  Appending bytes only adds
entries, and after an edit the pass stops as soon as it has met the old
entries again over a stretch as long as the longest token.

A text is cut by the pre-tokenizer pattern first; each match is encoded on its
own.  Ranks are read from a ``.tiktoken`` file that every worker can open.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Pieced, map_text


class Ranks:
    """Merge ranks with what the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        # Spines: the chain of right (left) parts of a token, longest first, as
        # far as the merges that build the token go; None: merges never build it.
        self._spines: tuple[dict, dict] = {}, {}
        #: Whether two tokens can stand side by side, by ``left << 32 | right``.
        self.pairs: dict[int, bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost first; only for short strings."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, 1 << 62), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 62:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the merge that makes ``token``, if merges do make it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.rank.get(a + b, 1 << 62), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 62:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 and token in self.rank else None

    def spine(self, token: bytes, side: int) -> list[bytes] | None:
        known = self._spines[side]
        if token not in known:
            chain = [token]
            while chain and len(chain[-1]) > 1:
                parts = self._split(chain[-1])
                chain = [*chain, parts[side]] if parts else None
            known[token] = chain
        return known[token]

    def beside(self, u: int, t: int) -> bool:
        """Whether no merge across the border of ``u`` and ``t`` comes before their own merges.

        The border's neighbours are walked from single bytes upwards.  The pair
        (a, b) is there until the earlier of the merges that take a into its
        parent and b into its; a merge of a + b of a lower rank breaks the
        border (on equal ranks the leftmost merge goes first).
        """
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[u << 32 | t] = self._walk(self.spine(self.bytes_of[u], 1), self.spine(self.bytes_of[t], 0))
        return found

    def alone(self, t: int) -> bool:
        """Whether merges build ``t`` at all."""
        return self.spine(self.bytes_of[t], 0) is not None

    def _walk(self, right: list[bytes] | None, left: list[bytes] | None) -> bool:
        if right is None or left is None:
            return False
        rank, never = self.rank, 1 << 62
        i, j = len(right) - 1, len(left) - 1
        while True:
            until_a = rank[right[i - 1]] if i else never
            until_b = rank[left[j - 1]] if j else never
            across = rank.get(right[i] + left[j], never)
            if across < until_a and across <= until_b and across != never:
                return False
            if until_a == until_b == never:
                return True
            if until_a <= until_b:
                i -= 1
            else:
                j -= 1


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


load_ranks = lru_cache(maxsize=4)(read_ranks)


class PrefixTable:
    """Last tokens (as ids) of all prefixes of one byte string, open to appends and edits."""

    def __init__(self, ranks: Ranks, text: bytes = b""):
        self.ranks, self.text, self.last = ranks, b"", [-1]
        self.append(text)

    def _extend(self, stop: int) -> None:
        """Entries up to prefix ``stop``: the one token that ends there and may follow what is before it."""
        text, last, r = self.text, self.last, self.ranks
        rank, pairs = r.rank.get, r.pairs.get
        for i in range(len(last), stop + 1):
            for k in range(i - 1, -1, -1):
                piece = text[k:i]
                t = rank(piece)
                if t is None:
                    if piece in r.tails:
                        continue
                    raise ValueError(f"no token ends at byte {i} here")
                if k:
                    ok = pairs(last[k] << 32 | t)
                    if ok is None:
                        ok = r.beside(last[k], t)
                else:
                    ok = r.alone(t)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} here")

    def append(self, more: bytes) -> None:
        """Add bytes; entries of the old prefixes stay as they are."""
        self.text += more
        self._extend(len(self.text))

    def become(self, text: bytes) -> None:
        """Hold another string: entries of the shared prefix stay, the rest is appended."""
        same = 0
        for a, b in zip(self.text, text, strict=False):
            if a != b:
                break
            same += 1
        del self.last[same + 1:]
        self.text = text
        self._extend(len(text))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of ``text[start:end]``; returns how many entries were computed.

        An entry depends on the longest token's length of bytes and entries
        before it, so after that many equal entries behind the edit the rest
        is as it was.
        """
        old = self.last[end + 1:]
        self.text = self.text[:start] + new + self.text[end:]
        del self.last[start + 1:]
        behind = start + len(new)
        self._extend(behind)
        same = 0
        for j, before in enumerate(old):
            self._extend(behind + j + 1)
            same = same + 1 if self.last[-1] == before else 0
            if same >= self.ranks.longest:
                self.last += old[j + 1:]
                return behind + j + 1 - start
        return len(self.text) - start

    def ids(self) -> list[int]:
        out, i, bytes_of = [], len(self.text), self.ranks.bytes_of
        while i:
            out.append(self.last[i])
            i -= len(bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to ids and back; pieces met before come from a bounded memo."""

    def __init__(self, ranks: Ranks, pattern: str, memo: int = 500_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.text_ids = Pieced(self._parts, memo)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of sorted parts; a match goes on from the entries of the prefix it shares with the one before."""
        out, rank, table = [], self.ranks.rank, PrefixTable(self.ranks)
        for part in parts:
            ids = []
            for match in self.pattern.findall(part):
                raw = match.encode()
                if raw in rank:
                    ids.append(rank[raw])
                else:
                    table.become(raw)
                    ids += table.ids()
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode_many(self, texts: list[str]):
        for raw in self.text_ids(texts):
            yield np.frombuffer(raw, "<u4")

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: ``id, ids array<int>``; a null or empty text has no ids.

    Rows are independent: repeated rows give repeated results, and null ids
    are kept.  No row leaves its task, so hot keys do not matter.  A task has
    an encoder of its own, which goes with it (workers outlive their tasks).
    """
    def setup():
        enc = Encoder(read_ranks(path), pattern, memo=100_000)
        return lambda texts: ((ids.astype(np.int32),) for ids in enc.encode_many([(t or b"").decode() for t in texts]))

    return map_text(docs, None, {"ids": "array<int>"}, id_col=id_col, text_col=text_col, setup=setup)


def decode(rows: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of the id arrays of :func:`encode`: ``id, text binary`` (null ids: empty)."""
    import pyarrow as pa

    id_type = dict(rows.dtypes)[id_col]

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([enc.decode(i or ()) for i in b.column(1).to_pylist()], pa.binary())],
                [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text binary")


def digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every text in one pass.

    Returns ``id, n_tokens, ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (of the bytes decoded from the ids).
    """
    def setup():
        enc = encoder(path, pattern)
        sha = hashlib.sha256
        decimal = [str(i) for i in range(max(enc.ranks.bytes_of, default=0) + 1)]

        def many(texts):
            for raw in enc.encode_many([(t or b"").decode() for t in texts]):
                ids = raw.tolist()
                joined = ",".join(map(decimal.__getitem__, ids)).encode()
                yield len(ids), sha(joined).hexdigest(), sha(enc.decode(ids)).hexdigest()

        return many

    return map_text(docs, None, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"},
                    id_col=id_col, text_col=text_col, setup=setup)
