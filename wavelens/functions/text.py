"""Text column functions: the normaliser (F1-F5), word splits, base name (F8)
and two-decimal text (F9).

Everything is a built-in Spark expression, so it runs inside whole-stage
codegen. Spark's ``\\w`` and ``\\s`` are ASCII-only, so the classes below are
spelled out to match Python 3's Unicode ``str`` regexes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``\s`` (and ``str.strip()``) treat as
# whitespace, written in ``\x{..}`` form, which both Java regex and RE2 read.
WS_CLASS = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's ``[^\w\s]``: anything that is not a letter, a number, underscore or
# whitespace.
PUNCT_RE = r"[^\p{L}\p{N}_" + WS_CLASS + r"]"
WS_RUN_RE = r"[" + WS_CLASS + r"]+"
WS_MULTI_RE = r"[" + WS_CLASS + r"][" + WS_CLASS + r"]+"
WS_ODD_RE = r"\x{20}[" + WS_CLASS + r"]+|[" + WS_CLASS.replace(r"-\x{20}", r"-\x{1f}") + r"][" + WS_CLASS + r"]*"   # runs but one space
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS_ENDS_RE = r"^[" + WS_CLASS + r"]+|[" + WS_CLASS + r"]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c) -> Column:
    """lower-case."""
    return F.lower(_c(c))


def remove_punctuation(c) -> Column:
    """F2: drop everything but letters, numbers, underscore and whitespace."""
    return F.regexp_replace(_c(c), F.lit(PUNCT_RE), F.lit(""))


def collapse_whitespace(c) -> Column:
    """each run of whitespace becomes one space."""
    return F.regexp_replace(_c(c), F.lit(WS_ODD_RE), F.lit(" "))


def strip_ws(c) -> Column:
    """F4 in the general form: strip Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def normalize_text(c) -> Column:
    """lower-case, remove punctuation, collapse whitespace, strip.

    After the collapse only plain spaces remain, so ``trim`` is enough.
    A NULL input stays NULL.
    """
    return F.trim(collapse_whitespace(remove_punctuation(lower(c))))


def words(c) -> Column:
    """Split on runs of whitespace; empty input gives an empty array."""
    return F.array_remove(F.split(_c(c), WS_RUN_RE), "")


def wer_text(c) -> Column:
    """Text for plain WER: runs of two or more whitespace characters become
    one space, ends are stripped. Its words lie between spaces only: a lone
    newline stays inside a word."""
    return strip_ws(F.regexp_replace(_c(c), F.lit(WS_MULTI_RE), F.lit(" ")))


def wer_words(c) -> Column:
    """Words of :func:`wer_text`."""
    return F.array_remove(F.split(wer_text(c), " "), "")


def normalized_words(c) -> Column:
    """Words of the normalised text (F5 output split on its single spaces)."""
    return F.array_remove(F.split(normalize_text(c), " "), "")


def basename(c) -> Column:
    """F8: last element of a '/'-separated path."""
    return F.element_at(F.split(_c(c), "/"), -1)


def two_decimals(c) -> Column:
    """text with two decimals, rounded like Python's ``f"{x:.2f}"``:
    half-even on the exact binary value (``format_number``; plain
    ``format_string('%.2f')`` rounds the shortest decimal form half up and
    differs, e.g. 0.125 -> 0.13). Grouping commas are removed."""
    return F.regexp_replace(F.format_number(_c(c), 2), ",", "")


def register_sql_functions(spark) -> None:
    """Make the normaliser callable from SQL as ``normalize_text(x)``."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING "
        "RETURN trim(regexp_replace(regexp_replace(lower(t), "
        f"'{_sql_lit(PUNCT_RE)}', ''), '{_sql_lit(WS_RUN_RE)}', ' '))")


def _sql_lit(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")
