"""Splitting oversized items at natural boundaries (problem 2).

Boundaries have levels: section, paragraph, sentence, clause, word, character. An item is split at those of the first
level; every part that is still too long is split at those of the next, and so on, characters last, and then never
before a combining mark or inside a joined emoji unless a single such character is too long. The parts are packed
greedily, in order, into pieces up to the limit; each piece but the first starts ``overlap`` characters before the
end of the one before. A part is too long if it doesn't fit beside the overlap, so every piece adds at least one.
Each level looks only at parts that are too long, so no text is searched more than once for a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSERS = "\"'”’»›」』）】〉》〕］｝)\\]}｣"
#: Where a text pauses, from the longest pause to the shortest; a cut comes after the match.
LEVELS = (
    re.compile(r"\n[ \t　]*\n\s*|\n[ \t]*(?:[*＊※◇◆★☆—-][ \t]*){3,}\n"),
    re.compile(r"\n"),
    re.compile(f"(?:[。！？｡।॥؟۔]+|…+(?!…)|(?<=\\w\\w\\w)[.!?]+(?=[{CLOSERS}]*\\s)|[!?]+)[{CLOSERS}]*\\s*"),
    re.compile(f"(?:[，、；：､،؛]+|——|[,;:](?=\\s))[{CLOSERS}]*\\s*"),
    re.compile(r"\s+"),
)
_JOINERS = "‍︎️"
_MARK = r"[̀-֑ͯ-ֽً-ٟऀ-ःऺ-ॏัิ-ฺ็-๎⃐-⃿゙゚︀-️‍]|[\U0001f3fb-\U0001f3ff]"
_CLUSTER = re.compile(f"(?s).(?:{_MARK}|(?<=[{_JOINERS}]).)*")


def parts(text: str, begin: int, end: int, room: int, level: int = 0) -> Iterator[int]:
    """Ends of the parts of ``text[begin:end]`` that have at most ``room`` characters."""
    if end - begin <= room:
        yield end
        return
    if level == len(LEVELS):
        at = begin
        for m in _CLUSTER.finditer(text, begin, end):
            while m.end() - at > room:
                at += room
                yield at
            if m.end() > at:
                at = m.end()
                yield at
        return
    at = begin
    if level > 1 or text.find("\n", begin, end) >= 0:
        for m in LEVELS[level].finditer(text, begin, end):
            if at < m.end() < end:
                yield from parts(text, at, m.end(), room, level + 1)
                at = m.end()
    yield from parts(text, at, end, room, level + 1)


def pieces(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; one piece if it fits."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    start = last = 0
    if len(text) > limit:
        for end in parts(text, 0, len(text), limit - overlap):
            if end - start > limit:
                yield start, last
                start = last - overlap
            last = end
    yield start, len(text)


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: str = "limit", overlap: str = "overlap", with_text: bool = True) -> DataFrame:
    """Pieces of every item longer than its limit.

    Returns ``keys``, piece_no, start_pos, end_pos (code points) and, with ``with_text``, the piece. Items within
    their limit, null items and items whose limit is null give no row; a limit below 1 counts as 1; a null or
    negative overlap as 0, one of the limit or more as limit - 1. Repeated items give the same pieces each.
    Other columns are dropped. Only oversized items reach Python.
    """
    long = df.where(F.col(limit).isNotNull() & (F.char_length(text) > F.greatest(F.col(limit), F.lit(1)))).select(*keys, F.col(text).alias("_text"), F.col(limit).alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).alias("_overlap"))
    schema = long.select(*keys).schema.add("piece_no", "integer").add("start_pos", "integer").add("end_pos", "integer")
    if with_text:
        schema = schema.add("piece", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                row, no, start, end, out = [], [], [], [], []
                cols = (batch.column(c).to_pylist() for c in ("_text", "_limit", "_overlap"))
                for i, (t, n, o) in enumerate(zip(*cols, strict=True)):
                    for k, (a, b) in enumerate(pieces(t, n, o)):
                        row.append(i)
                        no.append(k)
                        start.append(a)
                        end.append(b)
                        if with_text:
                            out.append(t[a:b])
                take = pa.array(row, pa.int64())
                arrays = [batch.column(k).take(take) for k in keys] + [pa.array(x, pa.int32()) for x in (no, start, end)]
                if with_text:
                    arrays.append(pa.array(out, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return long.mapInArrow(run, schema)
