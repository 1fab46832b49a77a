"""Figures as Chinese numerals, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import bound

FIGURES, NUMERALS = "0123456789", "零一二三四五六七八九"
BIG_UNITS = ("兆", "亿", "万", "")
#: Longer numbers than this are read figure by figure.
LONGEST = 16
#: Decimals before percentages, then years, then whole numbers; everything else between them.
TOKENS = r"[0-9]+\.[0-9]+|[0-9]+%|[0-9]{4}年|[0-9]+|[^0-9]+"


def figures_to_zh(s: Column) -> Column:
    """Each figure on its own."""
    return F.translate(s, FIGURES, NUMERALS)


def four_to_zh(group: Column) -> Column:
    """A string of four figures; nothing for 0000. 10 at the front of a group is read without the one."""
    a, b, c, d = (F.substring(group, i, 1) for i in (1, 2, 3, 4))
    has = [x != "0" for x in (a, b, c, d)]
    empty = F.lit("")
    front = ~has[0] & ~has[1]
    thousands = F.when(has[0], F.concat(figures_to_zh(a), F.lit("千"))).otherwise(empty)
    hundreds = F.when(has[1], F.concat(figures_to_zh(b), F.lit("百"))).otherwise(empty)
    gap = F.when(has[0] & ~has[1], F.lit("零")).otherwise(empty)
    tens = F.when(has[2], F.concat(gap, F.when(front & (c == "1"), F.lit("十")).otherwise(F.concat(figures_to_zh(c), F.lit("十"))))).otherwise(empty)
    ones = F.when(has[3], F.concat(F.when(~has[2] & ~front, F.lit("零")).otherwise(empty), figures_to_zh(d))).otherwise(empty)
    return F.concat(thousands, hundreds, tens, ones)


def number_to_zh(figures: Column) -> Column:
    """A string of figures, read as a number; leading zeros don't count."""

    def grouped(padded: Column) -> Column:
        parts = []
        for i, unit in enumerate(BIG_UNITS):
            group = F.substring(padded, 4 * i + 1, 4)
            zero = F.when(group.startswith("0") & (F.substring(padded, 1, 4 * i) != "0" * (4 * i)), F.lit("零")).otherwise(F.lit("")) if i else F.lit("")
            parts.append(F.when(group == "0000", F.lit("")).otherwise(F.concat(zero, bound(group, four_to_zh), F.lit(unit))))
        return F.concat(*parts)

    def read(plain: Column) -> Column:
        short = bound(F.lpad(plain, LONGEST, "0"), grouped)
        return F.when(plain == "", F.lit("零")).when(F.length(plain) > LONGEST, figures_to_zh(plain)).otherwise(short)

    return bound(F.regexp_replace(figures, "^0+", ""), read)


def convert_numbers(s: Column) -> Column:
    """Decimals, percentages, years of four figures before 年, and whole numbers, wherever they stand in a text."""

    def read(token: Column) -> Column:
        number = number_to_zh(F.regexp_extract(token, "^[0-9]+", 0))
        fraction = F.substring_index(token, ".", -1)
        before = F.when(token.endswith("%"), F.lit("百分之")).otherwise(F.lit(""))
        after = F.when(token.contains("."), F.concat(F.lit("点"), figures_to_zh(fraction))).otherwise(F.lit(""))
        return F.when(~token.rlike("^[0-9]"), token).when(token.endswith("年"), figures_to_zh(token)).otherwise(F.concat(before, number, after))

    # texts without figures, most of them, pass by
    return F.when(~s.rlike("[0-9]"), s).otherwise(F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TOKENS), F.lit(0)), read), ""))


def normalize_for_speech(s: Column, numbers: bool | Column = True) -> Column:
    """Form KC, white space, wide punctuation and, with ``numbers``, figures as numerals."""
    from .text import nfkc, normalize_whitespace, widen_punctuation

    plain = widen_punctuation(normalize_whitespace(nfkc(s)))
    if isinstance(numbers, bool):
        return convert_numbers(plain) if numbers else plain
    return F.when(numbers, convert_numbers(plain)).otherwise(plain)
