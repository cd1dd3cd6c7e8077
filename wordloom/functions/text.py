"""Tokenizer as native Column expressions.

Everything here compiles to JVM string/array expressions; no Python runs per
row.  A token is, tried in this order at each position:

* a well-formed tag: ``<``, optional ``/``, letters/digits/``_``/``-``, ``>``
* a maximal run of alphanumeric characters (Unicode Alphabetic or Numeric)
* any other single character (code point)

Whitespace characters are either kept as one-character tokens or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six section tags that frame a tokenized document.
INPUT_OPEN, INPUT_CLOSE = "<input>", "</input>"
CONTEXT_OPEN, CONTEXT_CLOSE = "<context>", "</context>"
OUTPUT_OPEN, OUTPUT_CLOSE = "<output>", "</output>"

# Token patterns (Java regex).  The last alternative decides
# what happens to a character that is neither part of a tag nor of a run:
# with whitespace kept it is any code point, otherwise any non-whitespace
# code point, so ``regexp_extract_all`` steps over whitespace for free.
_TAG = r"</?[\p{IsAlphabetic}\p{N}_-]*>"
_RUN = r"[\p{IsAlphabetic}\p{N}]+"
TOKEN_PATTERN_KEEP_WS = r"(?s)" + _TAG + "|" + _RUN + "|."
TOKEN_PATTERN_DROP_WS = r"(?s)" + _TAG + "|" + _RUN + r"|[^\p{IsWhite_Space}]"
WHITESPACE_PATTERN = r"^\p{IsWhite_Space}$"
PUNCT_PATTERN = r"\p{Punct}"  # the 32 ASCII punctuation characters


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text, lowercase: bool = False, strip_punctuation: bool = False) -> Column:
    """Optional full-Unicode lowercase, then removal of ASCII punctuation."""
    c = _col(text)
    if lowercase:
        c = F.lower(c)
    if strip_punctuation:
        c = F.regexp_replace(c, PUNCT_PATTERN, "")
    return c


def tokenize(text, lowercase: bool = False, strip_punctuation: bool = False,
             keep_whitespace: bool = False) -> Column:
    """``ARRAY<STRING>`` of tokens of one text (empty text -> [])."""
    pattern = TOKEN_PATTERN_KEEP_WS if keep_whitespace else TOKEN_PATTERN_DROP_WS
    c = normalize(F.coalesce(_col(text), F.lit("")), lowercase, strip_punctuation)
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def drop_whitespace_tokens(tokens) -> Column:
    """T3 as an array filter, for token arrays produced elsewhere."""
    return F.filter(_col(tokens), lambda t: ~t.rlike(WHITESPACE_PATTERN))


def tokenize_document(input_col="input", context_col="context", output_col="output",
                      lowercase: bool = False, strip_punctuation: bool = False,
                      keep_whitespace: bool = False) -> Column:
    """T4: tokens of input, context and output, each framed by its tags."""
    def toks(c):
        return tokenize(c, lowercase, strip_punctuation, keep_whitespace)

    return F.concat(
        F.array(F.lit(INPUT_OPEN)), toks(input_col), F.array(F.lit(INPUT_CLOSE)),
        F.array(F.lit(CONTEXT_OPEN)), toks(context_col), F.array(F.lit(CONTEXT_CLOSE)),
        F.array(F.lit(OUTPUT_OPEN)), toks(output_col), F.array(F.lit(OUTPUT_CLOSE)),
    )


def _section(tokens: Column, open_tag: str, close_tag: str):
    """Return (valid, text, rest) for a leading ``open ... close`` section."""
    starts = F.get(tokens, 0) == F.lit(open_tag)
    close_at = F.array_position(tokens, close_tag)  # 1-based, 0 when absent
    valid = F.coalesce(starts, F.lit(False)) & (close_at > 1)
    text = F.array_join(F.slice(tokens, 2, F.greatest(close_at - 2, F.lit(0))), "")
    rest = F.slice(tokens, close_at + 1, F.greatest(F.size(tokens) - close_at, F.lit(0)))
    return valid, text, rest


def detokenize(tokens) -> Column:
    """T5: rebuild ``struct(input, context, output)`` or null if malformed.

    Sections must appear in order; the first closing tag ends a section and
    tokens after the output section are ignored.
    """
    t = _col(tokens)
    ok1, input_text, rest1 = _section(t, INPUT_OPEN, INPUT_CLOSE)
    ok2, context_text, rest2 = _section(rest1, CONTEXT_OPEN, CONTEXT_CLOSE)
    ok3, output_text, _ = _section(rest2, OUTPUT_OPEN, OUTPUT_CLOSE)
    doc = F.struct(input_text.alias("input"), context_text.alias("context"),
                   output_text.alias("output"))
    return F.when(ok1 & ok2 & ok3, doc)
