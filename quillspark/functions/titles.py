"""Titles, identifiers and file names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# Titles that stand for none, compared without regard to ASCII case.
PLACEHOLDERS = ("chapter", "unknown", "untitled")
UNKNOWN = "未知"
#: Characters of the first paragraph that make a title, and what is stripped from its ends.
TITLE_CHARS = 32
EDGES = "。，,.；;：:"


def strip(s: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def is_placeholder(title: Column) -> Column:
    """True for null, blank and placeholder titles."""
    t = strip(title)
    return F.coalesce((t == "") | F.lower(t).isin(*PLACEHOLDERS) | (t == UNKNOWN), F.lit(True))


def title_from_paragraphs(paragraphs: Column) -> Column:
    """The start of the first paragraph, null if there is nothing in it."""
    first = strip(F.get(paragraphs, 0))
    cut = F.regexp_replace(strip(F.substring(first, 1, TITLE_CHARS)), f"^[{SPACE}{EDGES}]+|[{SPACE}{EDGES}]+$", "")
    return F.when(cut != "", cut)


def choose_title(extracted: Column, item_id: Column, paragraphs: Column) -> Column:
    """The extracted title, else the id, else the start of the text, else 'Chapter'."""
    return F.coalesce(F.when(~is_placeholder(extracted), extracted), F.when(~is_placeholder(item_id), item_id), title_from_paragraphs(paragraphs), F.lit("Chapter"))


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def safe_book_id(title: Column, source: Column) -> Column:
    """Title (else file stem, else 'book') with everything but letters, figures, - and _ replaced by _."""
    name = F.coalesce(F.when(strip(title) != "", strip(title)), F.when(file_stem(source) != "", file_stem(source)), F.lit("book"))
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def safe_file_name(name: Column) -> Column:
    """As above but blanks stay; nothing left but _ and blanks gives 'chapter'."""
    clean = strip(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N} _-]", "_"))
    return F.when(clean.rlike("^[_ ]*$"), F.lit("chapter")).otherwise(clean)


def wav_path(folder: Column | str, number: Column, title: Column) -> Column:
    """<folder>/<three-digit number>_<title>.wav"""
    return F.concat(F.lit(folder) if isinstance(folder, str) else folder, F.lit("/"), F.format_string("%03d_%s.wav", number, safe_file_name(title)))
