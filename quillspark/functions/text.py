"""Text scalars as Catalyst expressions: whitespace, punctuation, sentence and character rules.

Lengths are counted in code points. Null inputs give null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"\p{IsWhite_Space}"
# The white space of Unicode.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Punctuation that Unicode compatibility folding made narrow and speech engines want wide; the comma stays narrow.
NARROW, BROAD = "!?;:", "！？；："
#: Characters after which an overlong sentence may be cut.
SOFT_BREAKS = "，,、；;：:"
#: A sentence: up to a run of terminators with closing marks, a full stop only before a blank or the end.
SENTENCE = r"(?s).+?(?:(?:[。！？!?…]+|\.(?=\s|\z))[”’\"'）)】」』]*|\z)"


def normalize_whitespace(s: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def widen_punctuation(s: Column) -> Column:
    """The marks of ``NARROW`` in their wide form."""
    return F.translate(s, NARROW, BROAD)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(s: Column) -> Column:
    """Unicode normalization form KC, by batches in Python: no expression of the engine knows the form."""
    return _nfkc(s)


def char_count(s: Column) -> Column:
    return F.char_length(s)


def split_sentences(s: Column) -> Column:
    """Trimmed, non-empty sentences; a text of white space alone gives one empty string."""
    parts = F.filter(F.transform(F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(0)), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.btrim(s, F.lit(WHITE))))


def last_soft_break(s: Column) -> Column:
    """Position after the last soft break, null if there is none."""
    head = F.length(F.regexp_extract(s, f"(?s)^(.*[{SOFT_BREAKS}])", 1))
    return F.when(head > 0, head)


def soft_pieces(s: Column, n: int) -> Column:
    """The whole text in pieces: while n characters or more are left, up to the last soft break within the next n,
    else n of them; then what is left. Nothing is trimmed; an empty text has no pieces."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=.{{{n}}})(?:.{{0,{n - 1}}}[{SOFT_BREAKS}]|.{{{n}}})|.+"), F.lit(0))


def leading(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def split_at(s: Column, n: Column) -> tuple[Column, Column]:
    """The first n characters and the rest."""
    return F.substring(s, F.lit(1), n), F.substring(s, n + 1, F.char_length(s))
