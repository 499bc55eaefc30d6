"""Scalar text functions.

All are native Spark expressions over strings and arrays (higher-order
functions for per-token work), so text is processed whole inside the
executor's codegen, with no Python worker and no explode/shuffle.
The regular expressions use only classes that Java regex and RE2 read
the same way (``\\W`` is ASCII in both).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define the text operators.
WORD_SPLIT = r"\W+"                        # X2 tokeniser gaps
SENTENCE_END = r"[.!?]\s+"                 # X3 sentence boundary
SENTENCE_SPLIT = r"(?<=[.!?])\s+"          # X3 split form of the same boundary
PUNCT_SPACE = r"[\p{P}\p{Z}]"              # N17 Unicode punctuation + separators
LETTERS = r"[a-zA-Z]+"                     # X16 any ASCII word
NON_USEFUL_LIKE = ("%star%", "%...%")   # fixed values of the X16 rule
NON_LETTER = r"[^A-Za-z]"                  # X4 normaliser cleanup
CAPITAL = r"[A-Z]"                         # N22 token holds a capital
WORD_RUN = r"\w+"                          # one token of the WORD_SPLIT tokeniser
CAPITAL_WORD = r"\w*[A-Z]\w*"              # one token holding a capital


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def tokens(col: str | Column, pattern: str = WORD_SPLIT, lower: bool = True,
           min_length: int = 1) -> Column:
    """Regex-gap tokens (``RegexTokenizer`` semantics), empties dropped."""
    c = _c(col)
    if lower:
        c = F.lower(c)
    parts = F.split(F.coalesce(c, F.lit("")), pattern)
    return F.filter(parts, lambda t: F.length(t) >= min_length)


def sentences(col: str | Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(F.coalesce(_c(col), F.lit("")), SENTENCE_SPLIT)


def sentence_count(col: str | Column) -> Column:
    """X3 count: one more than the number of sentence boundaries."""
    return (F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(SENTENCE_END)) + 1).cast("long")


def normalise_tokens(tok: str | Column, lower: bool = False) -> Column:
    """Keep letters only in each token; drop tokens left empty."""
    t = F.transform(_c(tok), lambda x: F.regexp_replace(x, NON_LETTER, ""))
    if lower:
        t = F.transform(t, F.lower)
    return F.filter(t, lambda x: F.length(x) > 0)


def count_matching(tok: str | Column, regex: str = CAPITAL) -> Column:
    """Per-row count of tokens matching ``regex`` (fixes T3's table-wide count)."""
    return F.size(F.filter(_c(tok), lambda x: x.rlike(regex))).cast("long")


def count_char(col: str | Column, ch: str) -> Column:
    """Occurrences of a single character."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")


def token_count(col: str | Column, lower: bool = True) -> Column:
    """N19 on ``tokens(col)`` without building the array.

    The ``\\W+`` tokeniser yields exactly the maximal ``\\w`` runs, so their
    count is one regex scan (same result as ``size(tokens(col))``).
    """
    c = F.coalesce(_c(col), F.lit(""))
    return F.regexp_count(F.lower(c) if lower else c, F.lit(WORD_RUN)).cast("long")


def capital_token_count(col: str | Column) -> Column:
    """N22 without the array: tokens holding an ASCII capital, one regex scan
    (same result as ``count_matching(tokens(col, lower=False))``)."""
    return F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(CAPITAL_WORD)).cast("long")


def array_len(col: str | Column) -> Column:
    """Array size as bigint."""
    return F.size(_c(col)).cast("long")


def normalise_array(col: str | Column, total: str | Column | None = None) -> Column:
    """N21/T9 on an array of counts: each count divided by ``total``.

    Pass the row's token total as ``total`` (a column computed before this
    call; true TF). Without it the divisor is the array length, which is
    what the reference did on a vocabulary-sized vector. The divisor is
    never recomputed inside the element lambda.
    """
    a = _c(col)
    denom = F.size(a).cast("double") if total is None else _c(total).cast("double")
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), denom))


def clean_text(col: str | Column) -> Column:
    """Lower-case and drop Unicode punctuation and separators."""
    return F.regexp_replace(F.lower(_c(col)), PUNCT_SPACE, "")


def non_useful_flag(col: str | Column) -> Column:
    """1 when a short text carries no information, else 0 (null -> 0).

    Not useful: mentions "star", contains "...", has no ASCII word, or is
    only punctuation/space.
    """
    c = _c(col)
    lc = F.lower(c)
    cond = (lc.like(NON_USEFUL_LIKE[0]) | lc.like(NON_USEFUL_LIKE[1])
            | (F.regexp_extract(c, LETTERS, 0) == F.lit(""))
            | (F.regexp_replace(c, PUNCT_SPACE, "") == F.lit("")))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def contains_flag(col: str | Column, word: str) -> Column:
    """1 when the lower-cased text contains ``word``."""
    return F.when(F.lower(_c(col)).contains(word.lower()), F.lit(1)).otherwise(F.lit(0))
