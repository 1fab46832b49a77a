"""SQL of the segmentation: compatibility form, normalisation, sentences and chunks, as common table expressions.

Everything is told once more in SQL: forms by a table of characters, sentences by marking full stops that end one,
overlong sentences by recursion over windows, packing by a fold over lists.
"""

from __future__ import annotations

import functools
import unicodedata

from ..functions.text import SOFT_BREAKS, WHITE

# The white space of Unicode as a class.
SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WHITE = " || ".join(f"chr({ord(c)})" for c in WHITE)
#: Stands for a full stop that ends a sentence.
_STOP = "chr(63743)"


def trimmed(s: str) -> str:
    return f"trim({s}, {_WHITE})"


@functools.cache
def _compatible() -> tuple[str, str]:
    """Rows (character, compatibility decomposition), and a class of these characters."""
    rows, ranges = [], []
    for cp in range(0x30000):
        if unicodedata.decomposition(chr(cp)).startswith("<"):
            rows.append(f"(chr({cp}), '{unicodedata.normalize('NFKD', chr(cp)).replace(chr(39), chr(39) * 2)}')")
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return ", ".join(rows), "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def compatible(relation: str, out: str = "kc") -> str:
    """CTEs from ``relation(id, no, text)`` to ``kc(id, no, text)`` in normalization form KC."""
    rows, some = _compatible()
    return f"""compat(ch, plain) AS (VALUES {rows}),
    {out}_odd AS (SELECT id, no, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(length(text))) AS i FROM {relation} WHERE regexp_matches(text, '{some}')),
    {out}_made AS (SELECT id, no, nfc_normalize(string_agg(coalesce(plain, ch), '' ORDER BY i)) AS text FROM {out}_odd LEFT JOIN compat USING (ch) GROUP BY id, no),
    {out} AS (SELECT r.id, r.no, coalesce(m.text, nfc_normalize(r.text)) AS text FROM {relation} r LEFT JOIN {out}_made m ON m.id = r.id AND m.no = r.no)"""


def normalized(s: str) -> str:
    """White space and wide punctuation."""
    return f"translate(trim(regexp_replace({s}, '{SPACE}+', ' ', 'g')), '!?;:', '！？；：')"


def sentence_list(s: str) -> str:
    """The trimmed sentences of a text that are not empty."""
    marked = rf"regexp_replace({s}, '\.([\t\n\v\f\r ]|$)', {_STOP} || '\1', 'g')"
    found = f"regexp_extract_all({marked}, '(?s).+?(?:(?:[。！？!?…]+|\\x{{F8FF}})[”’\"''）)】」』]*|$)')"
    return f"list_filter(list_transform({found}, lambda x: {trimmed(f'replace(x, {_STOP}, chr(46))')}), lambda x: x <> '')"


def chunked(relation: str, limit: int = 160) -> str:
    """CTEs from ``relation(id, no, text)``, normalised paragraphs, to ``chunks(id, chunks)``."""
    return f"""sent AS (SELECT row_number() OVER (ORDER BY id, no, k) AS sid, * FROM (SELECT id, no, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT id, no, {sentence_list('text')} AS l FROM {relation} WHERE text <> ''))),
    cutting(sid, step, carry, tail, piece) AS (
        SELECT sid, 0, '', s, CAST(NULL AS VARCHAR) FROM sent WHERE length(s) > {limit}
        UNION ALL
        SELECT sid, step + 1, {trimmed('substr(w, n + 1)')}, tail, {trimmed('substr(w, 1, n)')} FROM (
            SELECT sid, step, w, tail, CASE WHEN soft > 0 THEN soft ELSE {limit} END AS n FROM (
                SELECT sid, step, w, tail, length(regexp_extract(w, '(?s)^(.*[{SOFT_BREAKS}])', 1)) AS soft FROM (
                    SELECT sid, step, carry || substr(tail, 1, {limit} - length(carry)) AS w, substr(tail, {limit} - length(carry) + 1) AS tail
                    FROM cutting WHERE length(carry) + length(tail) >= {limit})))),
    piece AS (SELECT sid, 0 AS step, s AS p FROM sent WHERE length(s) <= {limit}
        UNION ALL SELECT sid, step, piece FROM cutting WHERE piece IS NOT NULL
        UNION ALL SELECT sid, step + 1, {trimmed('carry || tail')} FROM cutting WHERE length(carry) + length(tail) < {limit}),
    folded AS (SELECT id, list_reduce(list({{'done': CAST([] AS VARCHAR[]), 'last': p}} ORDER BY sid, step), lambda a, x: CASE WHEN length(a.last) + 1 + length(x.last) > {limit}
        THEN {{'done': list_append(a.done, a.last), 'last': x.last}} ELSE {{'done': a.done, 'last': a.last || ' ' || x.last}} END) AS f FROM piece JOIN sent USING (sid) WHERE p <> '' GROUP BY id),
    chunks AS (SELECT id, list_append(f.done, f.last) AS chunks FROM folded)"""


#: Samples of a chapter that the tone engine speaks, from its chunks.
SAMPLES = "coalesce(CAST(list_sum(list_transform(chunks, lambda c: 480 * least(length(c), 200))) AS BIGINT), 0) + 3600 * greatest(coalesce(len(chunks), 0) - 1, 0)"
