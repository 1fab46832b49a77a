"""The scalars as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .audio import HEADER, PAUSE_MS, RATE, TONE_CHARS, TONE_MS
from .text import BROAD, NARROW, SOFT_BREAKS, SPACE
from .titles import EDGES, PLACEHOLDERS, TITLE_CHARS, UNKNOWN


def _strip(s: str) -> str:
    return rf"regexp_replace({s}, r'^{SPACE}+|{SPACE}+$', '')"


def _placeholder(s: str) -> str:
    names = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return f"coalesce({_strip(s)} = '' OR lower({_strip(s)}) IN ({names}) OR {_strip(s)} = '{UNKNOWN}', true)"


_STEM = r"regexp_replace(element_at(split(path, '/'), -1), r'(?<=.)\.[^.]*$', '')"
_START = rf"nullif(regexp_replace({_strip(f'substring({_strip("get(ps, 0)")}, 1, {TITLE_CHARS})')}, r'^[{SPACE}{EDGES}]+|[{SPACE}{EDGES}]+$', ''), '')"
_CLEAN = _strip(r"regexp_replace(name, r'[^\p{IsAlphabetic}\p{N} _-]', '_')")
FUNCTIONS = {
    "quill_whitespace": ("s STRING", "STRING", f"trim(regexp_replace(s, r'{SPACE}+', ' '))"),
    "quill_widen": ("s STRING", "STRING", f"translate(s, '{NARROW}', '{BROAD}')"),
    "quill_char_count": ("s STRING", "INT", "char_length(s)"),
    "quill_last_soft_break": ("s STRING", "INT", f"nullif(length(regexp_extract(s, r'(?s)^(.*[{SOFT_BREAKS}])', 1)), 0)"),
    "quill_figures": ("s STRING", "STRING", "translate(s, '0123456789', '零一二三四五六七八九')"),
    "quill_is_placeholder": ("title STRING", "BOOLEAN", _placeholder("title")),
    "quill_title_from": ("ps ARRAY<STRING>", "STRING", _START),
    "quill_choose_title": ("title STRING, item STRING, ps ARRAY<STRING>", "STRING", f"coalesce(CASE WHEN NOT {_placeholder('title')} THEN title END, CASE WHEN NOT {_placeholder('item')} THEN item END, {_START}, 'Chapter')"),
    "quill_file_stem": ("path STRING", "STRING", _STEM),
    "quill_book_id": ("title STRING, path STRING", "STRING", rf"regexp_replace(coalesce(nullif({_strip('title')}, ''), nullif({_STEM}, ''), 'book'), r'[^\p{{IsAlphabetic}}\p{{N}}_-]', '_')"),
    "quill_file_name": ("name STRING", "STRING", f"CASE WHEN {_CLEAN} RLIKE '^[_ ]*$' THEN 'chapter' ELSE {_CLEAN} END"),
    "quill_wav_path": ("folder STRING, number INT, name STRING", "STRING", f"concat(folder, '/', format_string('%03d_%s.wav', number, CASE WHEN {_CLEAN} RLIKE '^[_ ]*$' THEN 'chapter' ELSE {_CLEAN} END))"),
    "quill_text_hash": ("ps ARRAY<STRING>", "STRING", "sha2(array_join(transform(coalesce(ps, array()), p -> coalesce(p, '')), chr(10)), 256)"),
    "quill_tone_samples": ("chars INT, rate INT", "BIGINT", f"cast(floor(cast(rate AS BIGINT) * {TONE_MS} * least(greatest(chars, 1), {TONE_CHARS}) / 1000) AS BIGINT)"),
    "quill_pause_samples": ("chunks INT", "BIGINT", f"cast(greatest(chunks - 1, 0) * {RATE * PAUSE_MS // 1000} AS BIGINT)"),
    "quill_duration": ("bytes BIGINT, rate INT", "DOUBLE", f"coalesce(CASE WHEN bytes > {HEADER} THEN (bytes - {HEADER}) / 2 / rate END, 0D)"),
    "quill_percent": ("position INT, total INT", "INT", "cast(round(100D * position / total) AS INT)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; they are Catalyst expressions, not Python."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
