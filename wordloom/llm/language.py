"""Language ID in two steps: the family first, then one against one within it.

Linear support vector machines over hashed character n-grams (1 to 3, with
word borders) and words, as shares of all n-grams of a text.  A linear machine's
value for a text is the sum over its words, so a word's values are computed
once per task and kept in a bounded memo; whole texts are read.

Fitting uses a bounded sample of the labelled texts (``per_lang`` and ``most``
documents, drawn by a hash of the id with rates from exact counts); all else
covers every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import as_bytes, map_text, releasing, slices

DIM = 4096
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he am mt",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "sinitic": "zh",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if code in langs.split()), "other")


def letters(token: str) -> str:
    """A token's lower-cased letters."""
    word = token.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Slots of 32-bit sums of scaled code points."""
    h = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> 12)) % np.uint32(DIM)


def grams(words: list[str], step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(word's number, slot)`` of every n-gram of words (of letters alone), ``step`` letters at a time."""
    marked = [f"^{w}$" for w in words]
    yield np.arange(len(words)), np.array([zlib.crc32(m.encode()) % DIM for m in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(m) for m in marked])
    for at in range(0, len(code), step):
        h = np.zeros(min(step, len(code) - at), np.uint32)
        for n, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            part = code[at + n - 1:at + n - 1 + step]
            of = owner[at:at + len(part)]
            h = h[:len(part)] + part * np.uint32(factor)
            whole = of == owner[at + n - 1:at + n - 1 + step]
            yield of[whole], _mixed(h + np.uint32(n))[whole]


def vector(text: str) -> np.ndarray:
    """Shares of the hashed n-grams of a text (zeros without letters)."""
    words = [w for w in map(letters, text.split()) if w]
    found = sum((np.bincount(slot, minlength=DIM) for _, slot in grams(words)), np.zeros(DIM, np.int64))
    return found.astype(np.float32) / max(1, int(found.sum()))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient descent; y is +1 or -1, classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    step = 1.0 / (2 * float((weight * (x1 ** 2).sum(1)).sum()) + penalty)
    w = ahead = np.zeros(x1.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        grad = -2 * ((weight * y * slack) @ x1) + penalty * ahead
        new = ahead - step * grad
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


class Model:
    """Machines for all families and all pairs of languages of one family, as columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        lang, fam = np.array(langs), np.array([family_of(v) for v in langs])
        scale = x.std(0) + 1e-5
        self.center = x.mean(0)
        z = (x - self.center) / scale / np.sqrt(DIM)
        fits = [svm(z, np.where(fam == f, 1.0, -1.0).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {f: list(combinations([v for v in self.langs if family_of(v) == f], 2)) for f in self.families}
        for f in self.families:
            for a, b in self.pairs[f]:
                of = (lang == a) | (lang == b)
                fits.append(svm(z[of], np.where(lang[of] == a, 1.0, -1.0).astype(np.float32)))
        self.weights = np.array([w / scale / np.sqrt(DIM) for w, _ in fits], np.float64).reshape(len(fits), DIM).T
        self.bias = np.array([b - self.center @ w for (_, b), w in zip(fits, self.weights.T, strict=True)])

    def pick(self, sums: np.ndarray, total: float) -> tuple[str, float]:
        """Language and score from the summed values of a text's n-grams; ``und`` without n-grams."""
        if not total:
            return "und", 0.0
        value = sums / total + self.bias
        at, margin, family = 0, np.inf, self.families[0]
        if len(self.families) > 1:
            at = len(self.families)
            best = int(np.argmax(value[:at]))
            family, margin = self.families[best], value[best]
        for f in self.families:
            if f == family:
                break
            at += len(self.pairs[f])
        members = [v for v in self.langs if family_of(v) == family]
        if len(members) == 1:
            return members[0], _score(margin)
        votes, strength = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), v in zip(self.pairs[family], value[at:], strict=False):
            votes[a if v >= 0 else b] += 1
            strength[a] += v
            strength[b] -= v
        lang = max(members, key=lambda m: (votes[m], strength[m]))
        return lang, _score(min(margin, strength[lang] / (len(members) - 1)))


def _score(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))) if np.isfinite(margin) else 1.0


class Reader:
    """Languages of texts by a model, with a bounded memo of words' values.

    Texts are taken in groups of about ``group`` characters; the words that a
    group adds to the memo are valued together.  Words of more than 64
    characters leave the memo with their group.
    """

    def __init__(self, model: Model, limit: int = 60_000, group: int = 500_000):
        self.model, self.limit, self.group = model, limit, group
        self.columns = np.ascontiguousarray(model.weights.T)
        self.forget()

    def forget(self):
        self.at, self.rows, self.used = {}, np.zeros((1024, len(self.columns) + 1)), 0

    def _values(self, words: list[str]) -> np.ndarray:
        """Each word's summed weights by machine, then its number of n-grams."""
        out = np.zeros((len(words), len(self.columns) + 1))
        for owner, slot in grams(words):
            for j, column in enumerate(self.columns):
                out[:, j] += np.bincount(owner, column[slot], len(words))
            out[:, -1] += np.bincount(owner, minlength=len(words))
        return out

    def _learn(self, tokens: set[str]):
        """Give new tokens their rows; all without letters share one of zeros."""
        if self.used > self.limit:
            self.forget()
        new = sorted(tokens.difference(self.at))
        words = [letters(t) for t in new]
        kept = [i for i, w in enumerate(words) if w]
        need = self.used + len(kept) + 1
        if need > len(self.rows):
            self.rows = np.vstack([self.rows[:self.used], np.zeros((2 * need - self.used, self.rows.shape[1]))])
        self.at.update(dict.fromkeys(new, need - 1))
        self.rows[need - 1] = 0
        if kept:
            self.rows[self.used:need - 1] = self._values([words[i] for i in kept])
            self.at.update(zip([new[i] for i in kept], range(self.used, need - 1), strict=True))
        self.used = need

    def __call__(self, texts: list[bytes | None]) -> Iterator[tuple[str, float]]:
        group, size = [], 0
        for k, t in enumerate(texts):
            group.append(t.decode().split() if t else [])
            size += len(t or b"")
            if size > self.group or k + 1 == len(texts):
                tokens = set().union(*group)
                self._learn(tokens)
                row = self.at.__getitem__
                for text in group:
                    total = self.rows[list(map(row, text))].sum(0) if text else np.zeros(1)
                    yield self.model.pick(total[:-1], total[-1])
                for t in tokens:
                    if len(t) > 64:
                        del self.at[t]
                group, size = [], 0


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = 400, most: int = 2400) -> Model | None:
    """Fit on at most about ``per_lang`` texts of each language and ``most`` in all; None without labelled text.

    ``docs`` holds the rows to learn from; null texts, null languages and texts
    without letters are left out.  The sample is drawn by a hash of the id, at
    rates from the exact number of rows of each language.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        return None
    each = max(1, min(per_lang, most // len(counts)))
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches, 256):
            v = [vector(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["lang", "v"])

    got = sample.mapInArrow(run, "lang string, v binary").toPandas().sort_values(["lang", "v"])
    x = np.array([np.frombuffer(v, np.float32) for v in got["v"]]).reshape(len(got), DIM)
    has = x.any(1)
    return Model(x[has], got["lang"][has].tolist()) if has.any() else None


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row, from the text alone.

    ``und`` with score 0 for a null text, one without letters, or without a
    model.  The model (DIM values for each family and pair of related
    languages) goes to the tasks with the function.
    """
    def setup():
        return Reader(model) if model else lambda texts: [("und", 0.0)] * len(texts)

    return map_text(docs, None, {"lang_pred": "string", "score": "double"}, id_col=id_col, text_col=text_col, setup=setup)


def languages(text_col: str, model: Model) -> Column:
    """``lang_pred`` of :func:`identify` as a column: only the texts go to Python, only the languages come back."""
    @F.arrow_udf(StringType())
    def lang_pred(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(run)(arrays)

    def run(arrays):
        read = Reader(model)
        for texts in arrays:
            found = []
            for at in range(0, len(texts), 1024):
                found += [lang for lang, _ in read(as_bytes(texts.slice(at, 1024)))]
            yield pa.array(found, pa.string())

    return lang_pred(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
