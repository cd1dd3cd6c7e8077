"""Quality rules with risk-controlled thresholds.

Every rule is a share that is high in bad texts.  A stratum's candidate
cutoffs form one sequence for all rules together: from no rejection on, each
step gives up one more bin of one rule, those first whose documents are most
often labelled bad.  The order comes from all documents and the bad labels
alone, so the good labels stay a holdout for it.  A step is certified while the
exact binomial test rejects "more than ``risk`` of the stratum's good documents
fall to any of its rules" at its level, and testing stops at the first failure
(fixed sequence, so the steps need no further correction).  The level is
divided by the number of strata (Bonferroni).  All certified steps hold
together with probability 1 - ``delta``; the one that parts good from bad best
is taken, so the choice itself costs nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_text, space_words

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_WORD_CHARS = _CONTINUATION + b" \t\n\x0b\x0c\r"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
RULES = ("symbols", "dup_lines", "repeats", "upper", "bangs")
BINS = 200
FEATURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
            **{f"r_{r}": "int" for r in RULES}}


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def dup_lines(lines: list[bytes]) -> int:
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        n += line in seen and bool(line.split())
        seen.add(line)
    return n


def features_of(text: bytes | None) -> tuple:
    text = text or b""
    words, lines = space_words(text), text.split(b"\n")
    n_words, lacking = len(words), len(text)
    word_chars = len(text.translate(None, _NOT_WORD_CHARS))
    symbols = lacking - len(text.translate(None, SYMBOLS))
    dup, rep = dup_lines(lines), repeat_words(words)
    upper, letters = lacking - len(text.translate(None, _UPPER)), lacking - len(text.translate(None, _LETTERS))
    shares = ((symbols, word_chars), (dup, len(lines)), (rep, n_words), (upper, letters), (text.count(b"!"), n_words))
    return n_words, word_chars, symbols, dup, rep, *(min(BINS, -(-BINS * a // b)) if b else 0 for a, b in shares)


def binomial_at_most(x: int, n: int, p: float) -> float:
    """P(X <= x) for X ~ Binomial(n, p), summed from exact log terms."""
    if x >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(x + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def sequence(every: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """(rule, bin) in the order in which they are given up, from counts of all and of bad documents by rule and bin.

    A rule's bins go from the top down, in blocks of the highest share of bad
    ones; blocks of all rules are merged by that share, and those without any are left out.
    """
    steps = []
    for number, rule in enumerate(RULES):
        n, m = (np.concatenate([[0], np.cumsum(x[rule][:0:-1])]) for x in (every, bad))
        at = 0
        while at < BINS and m[at] < m[-1]:
            ratio = (m[at + 1:] - m[at]) / np.maximum(1, n[at + 1:] - n[at])
            end = at + 1 + int(np.argmax(ratio))
            steps += [(-float(ratio.max()), number, k) for k in range(at, end)]
            at = end
    return [(RULES[number], BINS - k) for _, number, k in sorted(steps)]


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """How many steps to take; ``good[t]`` documents fall at step t first, the last entry never.  0: none certified or useful."""
    n, m = int(good.sum()), int(bad.sum())
    best, at = 0.0, []
    for t in range(len(good)):
        fell = int(good[:t].sum())
        if not n or fell > risk * n or binomial_at_most(fell, n, risk) > level:
            break
        value = 10 * fell / n - bad[:t].sum() / max(1, m)
        if value < best:
            best, at = value, []
        if value == best < 0:
            at.append(t)
    return at[len(at) // 2] if at else 0


def fit(scored: DataFrame, labels: DataFrame, *, stratum_col: str, risk: float, delta: float,
        id_col: str = "doc_id") -> dict[tuple[str, str], int]:
    """Cutoffs by (stratum, rule).  Counts are summed in the executors; the driver sees strata x rules x bins.

    Labels with a null id or quality are left out; an id labelled both ways
    counts as good, and rows of one id and stratum as one document that falls
    with the first of them.  A stratum with too few good labels gets no
    cutoff: without any fall it takes ln(strata / delta) / -ln(1 - risk) of them.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max("quality") > 0).alias("__good"))
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r_{r}").alias("bin")) for r in RULES])).alias("x")
    every = scored.select(F.col(stratum_col).alias("s"), bins).groupBy("s", "x.rule", "x.bin").count()
    marked = (scored.join(marks, F.col(id_col) == F.col("__id"))
                    .select(F.col(stratum_col).alias("s"), "__id", "__good", bins).select("s", "__id", "__good", "x.*"))

    def tables(counts: DataFrame) -> dict:
        out: dict = {}
        for s, rule, b, n in counts.toLocalIterator():
            out.setdefault(s, {r: np.zeros(BINS + 1, np.int64) for r in RULES})[rule][b] += n
        return out

    bad = tables(marked.filter(~F.col("__good")).groupBy("s", "rule", "bin").agg(F.countDistinct("__id").alias("n")))
    if not bad:
        return {}
    all_docs = tables(every)
    order = {s: sequence(all_docs[s], t) for s, t in bad.items()}
    steps = scored.sparkSession.createDataFrame([(s, r, b, t) for s, o in order.items() for t, (r, b) in enumerate(o)],
                                                "s string, rule string, bin int, step int")
    fallen = (marked.join(F.broadcast(steps), ["s", "rule", "bin"], "left").groupBy("s", "__id", "__good").agg(F.min("step").alias("step"))
                    .groupBy("s", "__good", "step").count())
    falls = {s: np.zeros((2, len(o) + 1), np.int64) for s, o in order.items()}
    for s, good, step, n in fallen.toLocalIterator():
        if s in falls:
            falls[s][int(good), -1 if step is None else step] += n
    found: dict = {}
    for s, (no, yes) in falls.items():
        for rule, b in order[s][:choose(yes, no, risk, delta / len(all_docs))]:
            found[s, rule] = min(found.get((s, rule), BINS), b - 1)
    return found


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Features, base verdict and verdict of every text, one row per input row.

    ``kept`` is false if the base rules fail (fewer than 50 words, or more than
    half of them in repeated 3-word windows), else whether no certified rule
    of the row's stratum rejects it; ``rejected_by`` names the rules.  Strata:
    values of ``stratum_col``, null as ``und``.  Null and empty texts have no
    words and fail.  At most ``risk`` of a stratum's good documents fall to any
    of its rules, with probability 1 - ``delta`` for all strata at once.
    """
    text = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("s")).alias("__k"),
                       F.col(text_col).alias("__t"))
    scored = map_text(text, features_of, FEATURES, id_col="__k", text_col="__t")
    scored = materialize(scored.select(F.col("__k.id").alias(id_col), F.col("__k.s").alias("stratum"), *FEATURES))
    cutoffs = fit(scored, labels, stratum_col="stratum", risk=risk, delta=delta, id_col=id_col)
    lookup = F.create_map(*[F.lit(x) for (s, r), c in cutoffs.items() for x in (f"{s}\0{r}", c)]) if cutoffs else None
    over = [F.when(F.col(f"r_{r}") > lookup[F.concat(F.col("stratum"), F.lit(f"\0{r}"))], F.lit(r)) for r in RULES] if cutoffs else []
    rejected = F.concat_ws(",", *over) if over else F.lit("")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & (rejected == "")).alias("kept"),
                         rejected.alias("rejected_by"))
