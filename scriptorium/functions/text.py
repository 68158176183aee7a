"""Column-level text functions (all JVM-side except ``normalize_text``).

Every function takes and returns a ``Column`` so Catalyst can fuse it into the
surrounding projection (whole-stage codegen where the expression supports it).
"""

from __future__ import annotations

import string
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour
# ---------------------------------------------------------------------------
# Sentence boundary: one whitespace character after "." or "?", unless the
# period closes a capitalised two-letter abbreviation ("Mr.") or follows a digit
# ("1."). "(?U)" gives \d and \s their Unicode meaning, as in Python's re.
SENTENCE_PATTERN = r"(?U)(?<=[.?])(?<![A-Z][a-z]\.)(?<!\d\.)\s"
# Simple sentence split used by the document-level tasks: spaces after . ! ?
SIMPLE_SENTENCE_PATTERN = r"(?<=[.!?]) +"
# The 32 ASCII punctuation characters (Python's string.punctuation).
PUNCTUATION = string.punctuation
# Exhibit types kept for current filings.
CURRENT_FILING_EXHIBITS = ("EX-99.1", "EX-99.2", "EX-99.3", "EX-99", "EX-99.4", "EX-99.6", "EX-99.9")
# Pre-tokenisation: every digit alone, runs of letters/underscore, runs of punctuation.
PRETOKEN_PATTERN = r"(?U)\d|[^\W\d]+|[^\w\s]+"


def _strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_sentences(c: Column) -> Column:
    """Sentence split with the main boundary rule; trailing empty piece kept."""
    return F.split(c, SENTENCE_PATTERN, -1)


def split_sentences_simple(c: Column) -> Column:
    """Split at one or more spaces after '.', '!' or '?'."""
    return F.split(c, SIMPLE_SENTENCE_PATTERN, -1)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``)."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


_DIGIT_CHARS: str | None = None


def _digit_chars() -> str:
    """Every character for which Python's ``str.isdigit()`` is true, built from
    the Unicode database by rule (decimal digits plus superscripts, circled
    digits ...)."""
    global _DIGIT_CHARS
    if _DIGIT_CHARS is None:
        _DIGIT_CHARS = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isdigit())
    return _DIGIT_CHARS


def _count_in(c: Column, chars: str) -> Column:
    """Number of characters of ``c`` that belong to ``chars``: ``translate`` deletes
    them with one hash lookup per character (a long regex character class would be
    tested range by range)."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def digit_punct_count(c: Column) -> Column:
    """Number of characters that are digits (``isdigit``) or ASCII punctuation."""
    return _count_in(c, _digit_chars() + PUNCTUATION)


def digit_punct_fraction(c: Column, empty: float | None = None) -> Column:
    """Share of digit/punctuation characters.

    ``empty=None`` reproduces the base behaviour (empty text has no share -> NULL,
    which the chunk job treats as a failed document); ``empty=0.0`` is the
    current-filing variant.
    """
    n = F.length(c)
    frac = digit_punct_count(c).cast("double") / n.cast("double")
    res = F.when(n > 0, frac)
    if empty is not None:
        res = res.otherwise(F.lit(float(empty)))
    return res


def digit_count(c: Column) -> Column:
    return _count_in(c, _digit_chars())


def numeric_percentage(c: Column) -> Column:
    """Digits / length * 100 (NULL for empty text)."""
    n = F.length(c)
    # (digits / length) * 100 in this order: the float result decides ties at the limit
    return F.when(n > 0, (digit_count(c).cast("double") / n.cast("double")) * 100.0)


def percent_count(c: Column) -> Column:
    """Number of '%' characters."""
    return F.length(c) - F.length(F.replace(c, F.lit("%"), F.lit("")))


def flatten_newlines(c: Column) -> Column:
    """Newline -> space."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def strip_speaker_prefixes(lines: Column, min_length: int = 11, prefix_window: int = 20) -> Column:
    """F4 + X8: keep lines longer than ``min_length - 1`` characters, then drop a
    ``speaker:`` prefix when the first ':' sits inside the first ``prefix_window``
    characters (the text after the colon keeps its leading space)."""
    kept = F.filter(lines, lambda x: F.length(x) >= min_length)
    return F.transform(
        kept,
        lambda x: F.when(F.instr(F.substring(x, 1, prefix_window), ":") > 0,
                         x.substr(F.instr(x, ":") + 1, F.length(x))).otherwise(x),
    )


def keep_report_sentences(sentences: Column, max_numeric_pct: float = 15.0,
                          max_percent_symbols: int = 5) -> Column:
    """strip each sentence, keep non-blank ones with at most ``max_percent_symbols``
    '%' and at most ``max_numeric_pct`` percent digits (both inclusive)."""
    stripped = F.transform(sentences, _strip_ws)
    return F.filter(
        stripped,
        lambda s: (F.length(s) > 0)
        & (percent_count(s) <= max_percent_symbols)
        & (numeric_percentage(s) <= max_numeric_pct),
    )


# Characters that Python's ``str.strip`` removes beside the white space of Java's (?U)\s.
_STRIP_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def split_whitespace(c: Column) -> Column:
    """The stretches of a text between white space, after Python's ``strip`` (empty ones may be among them)."""
    return F.split(F.regexp_replace(c, _STRIP_EDGES, ""), r"(?U)\s+", -1)


def pretokenize(c: Column) -> Column:
    """X11: word runs or punctuation runs, every digit its own token."""
    return F.regexp_extract_all(c, F.lit(PRETOKEN_PATTERN), 0)


# ---------------------------------------------------------------------------
# X10 normalisation: NFD -> lowercase -> strip -> remove combining marks.
# Spark has no Unicode normalisation function, so this is the one Arrow UDF.
# ---------------------------------------------------------------------------
_MARKS: dict | None = None
# Texts that are normalised at once, in bytes; a batch of whole documents would otherwise be held as Python strings.
_BYTES_AT_ONCE = 1 << 20
# Different combining marks up to which each is removed by a search of its own, which takes far less than a lookup per character.
_FEW_MARKS = 8


def _mark_table() -> dict:
    """Translation table deleting every combining mark (category Mn), built once
    from the Unicode database. A plain global (not lru_cache) so UDF closures
    that use it pickle by value."""
    global _MARKS
    if _MARKS is None:
        _MARKS = {cp: None for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) == "Mn"}
    return _MARKS


def normalize_str(s: str | None, strip: bool = True) -> str | None:
    if s is None:
        return None
    plain = s.isascii()
    s = (s if plain else unicodedata.normalize("NFD", s)).lower()
    if strip:
        s = s.strip()
    if plain:
        return s
    table = _mark_table()
    marks = [c for c in set(s) if ord(c) in table]
    if len(marks) > _FEW_MARKS:
        return s.translate(table)
    for c in marks:
        s = s.replace(c, "")
    return s


def normalize_array(texts: pa.Array, strip: bool = True) -> pa.Array:
    """``normalize_str`` of an Arrow array, a stretch of about ``_BYTES_AT_ONCE`` at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // _BYTES_AT_ONCE)) + 1
    cuts = [0, *cuts.tolist(), len(texts)]
    return pa.concat_arrays([pa.array([normalize_str(t, strip) for t in texts.slice(a, z - a).to_pylist()], texts.type)
                             for a, z in zip(cuts, cuts[1:])])


@F.arrow_udf(StringType())
def _normalize_udf(s: pa.Array) -> pa.Array:
    return normalize_array(s)


def normalize_text(c: Column) -> Column:
    """NFD, lowercase, strip, strip accents (Arrow UDF)."""
    return _normalize_udf(c)


@F.arrow_udf(StringType())
def _normalize_inner_udf(s: pa.Array) -> pa.Array:
    return normalize_array(s, strip=False)


def normalize_inner(c: Column) -> Column:
    """X10 without the strip, for parts of a stripped text."""
    return _normalize_inner_udf(c)
