"""Text normalisation as native Column expressions.

Character classes are spelled out so Java regexes (Spark) and RE2 (DuckDB
oracle) agree with Python's Unicode ``\\s`` / ``\\w``: plain ``\\s`` and ``\\w``
are ASCII-only in Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace (Python str ``\s``) and word characters (``\w``).
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WS_INNER = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WORD_INNER = r"\p{L}\p{N}_"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Collapse whitespace runs to one space and trim; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WS + "+", " "))


def normalize_title(c) -> Column:
    """Title key: lower, non-word/non-space -> space, collapse, strip; null -> ''."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    cleaned = F.regexp_replace(lowered, f"[^{WORD_INNER}{WS_INNER}]", " ")
    return F.trim(F.regexp_replace(cleaned, WS + "+", " "))


def minhash_text(c) -> Column:
    """Text as hashed by MinHash: lower, collapse whitespace, strip."""
    return collapse_ws(F.lower(F.coalesce(_col(c), F.lit(""))))


def shingles(c, k: int = 9) -> Column:
    """Character k-grams (code points). len <= k -> [text]; '' -> []. Linear: slices of the character array."""
    chars = F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0))
    cut = lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - (k - 1), F.lit(1))),
                                 lambda i: F.array_join(F.slice(xs, i, k), ""))
    grams = F.transform(F.array(chars), cut)[0]
    return F.when(F.length(_col(c)) == 0, F.array().cast("array<string>")).otherwise(grams)


def rtrim_ws(c) -> Column:
    """Python ``str.rstrip()`` (all Unicode whitespace, not just spaces)."""
    return F.regexp_replace(_col(c), WS + "+$", "")


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_col(c), "^" + WS + "+|" + WS + "+$", "")
