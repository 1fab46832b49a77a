import pyarrow as pa

from quillspark.llm.text import chunks, codepoints, exploded, to_strings


def test_code_points_there_and_back():
    texts = pa.array(["é", None, "", "😀x", "中"])
    for part in (texts, texts.slice(1), texts.slice(2, 2)):
        assert to_strings(*codepoints(part)).to_pylist() == [t or "" for t in part.to_pylist()]
    assert to_strings(*codepoints(pa.array([], pa.string()))).to_pylist() == []


def test_lists():
    lists = pa.array([["a", None], None, [], ["b"]])
    for part, want in ((lists, [(0, 0, "a"), (0, 1, None), (3, 0, "b")]), (lists.slice(2), [(1, 0, "b")])):
        row, pos, values = exploded(part)
        assert list(zip(row.tolist(), pos.tolist(), values.to_pylist(), strict=True)) == want


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * n for n in (3, 50, 1, 1, 1, 0)]), pa.array([["y" * n] * 2 for n in (3, 50, 1, 1, 1, 0)])], names=["i", "s", "l"])
    for column in ("s", "l"):
        parts = list(chunks(batch, column, 10))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(6)) and len(parts) >= 3
        assert [i for p in chunks(batch.slice(2), column, 2) for i in p.column("i").to_pylist()] == [2, 3, 4, 5]
