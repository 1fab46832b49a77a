"""Arrow text as numpy code-point arrays, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the numpy operators; a single longer text makes a batch of its own.
CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` (strings, or lists of strings) holds about ``limit`` bytes."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    if pa.types.is_list(col.type):
        flat = pc.fill_null(pc.binary_length(col.values), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        total = ends[col.offsets.to_numpy()[1:]] - ends[col.offsets.to_numpy()[0]]
    else:
        total = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text starts (one more entry at the end)."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])] if len(texts) else b""
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4"), starts


def to_strings(cps: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The inverse of ``codepoints``."""
    size = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends[starts].astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def strings(column: pa.Array) -> pa.Array:
    """The column as one plain string array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def exploded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each element of the lists: its row, its position and its value; null lists have no element."""
    lists = lists if not lists.null_count else pc.fill_null(lists, pa.scalar([], lists.type))
    count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), count)
    first = np.cumsum(count) - count
    return row, np.arange(len(row)) - first[row], lists.flatten()
