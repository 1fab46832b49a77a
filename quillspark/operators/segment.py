"""Chapters as chunks of bounded length for a speech engine.

Normalisation and sentence splitting are Catalyst expressions over the array of paragraphs. Cutting overlong
sentences and packing are an ordered fold whose state grows; it runs in one vectorized Python pass per batch,
without shuffling, as a chapter stays in its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.numerals import normalize_for_speech
from ..functions.text import SOFT_BREAKS, WHITE, split_sentences

MAX_CHARS = 160


def cut_sentence(sentence: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters (at least one).

    A window of ``limit`` characters is cut after its last soft break, else at its end. What is left of it goes on,
    without white space at its ends, before the characters that follow.
    """
    limit = max(1, limit)
    pieces, rest, at = [], "", 0
    while len(rest) + len(sentence) - at >= limit:
        take = limit - len(rest)
        window, at = rest + sentence[at : at + take], at + take
        cut = max((window.rfind(c) for c in SOFT_BREAKS), default=-1) + 1 or limit
        left = window[:cut].strip(WHITE)
        if left:
            pieces.append(left)
        rest = window[cut:].strip(WHITE)
    rest = (rest + sentence[at:]).strip(WHITE)
    if rest:
        pieces.append(rest)
    return pieces


def pack_pieces(sentences: list[str], limit: int) -> list[str]:
    """Sentences joined by blanks into chunks as long as the limit allows; overlong ones are cut first."""
    chunks: list[str] = []
    current: list[str] = []
    size = 0
    for s in sentences:
        if not s:
            continue
        for piece in cut_sentence(s, limit) if len(s) > limit else (s,):
            if current and size + 1 + len(piece) > limit:
                chunks.append(" ".join(current))
                current, size = [], 0
            size += len(piece) + (1 if current else 0)
            current.append(piece)
    if current:
        chunks.append(" ".join(current))
    return chunks


@F.pandas_udf(ArrayType(StringType()))
def _pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sentences, limits in batches:
        yield pd.Series([pack_pieces(list(s), int(n)) if s is not None else None for s, n in zip(sentences, limits, strict=True)])


def chapter_sentences(paragraphs: Column, numbers: bool | Column = True) -> Column:
    """The sentences of all paragraphs of a chapter, in order; blank paragraphs have none."""
    plain = F.filter(F.transform(paragraphs, lambda p: normalize_after_kc(p, numbers)), lambda p: p != "")
    return F.filter(F.flatten(F.transform(plain, split_sentences)), lambda s: s != "")


def normalize_after_kc(p: Column, numbers: bool | Column) -> Column:
    """Normalisation of a paragraph that is in form KC already."""
    from ..functions.numerals import convert_numbers
    from ..functions.text import normalize_whitespace, widen_punctuation

    plain = widen_punctuation(normalize_whitespace(p))
    if isinstance(numbers, bool):
        return convert_numbers(plain) if numbers else plain
    return F.when(numbers, convert_numbers(plain)).otherwise(plain)


@F.pandas_udf(ArrayType(StringType()))
def _kc_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for paragraphs in batches:
        yield pd.Series([None if ps is None else [unicodedata.normalize("NFKC", p) if p is not None else "" for p in ps] for ps in paragraphs])


def with_chunks(df: DataFrame, paragraphs: str = "paragraphs", limit: int | Column = MAX_CHARS, numbers: bool | Column = True, out: str = "chunks") -> DataFrame:
    """``df`` with an array of chunks. Null paragraphs count as empty, a null array gives a null one; a limit below 1
    is refused, in a column it counts as 1."""
    if isinstance(limit, int) and limit < 1:
        raise ValueError(f"chunks must have at least one character, not {limit}")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    kc = df.withColumn("_kc", _kc_all(F.col(paragraphs)))
    return kc.withColumn(out, _pack(chapter_sentences(F.col("_kc"), numbers), limit)).drop("_kc")


__all__ = ["chapter_sentences", "cut_sentence", "normalize_for_speech", "pack_pieces", "with_chunks"]
