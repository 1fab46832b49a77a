import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_imported_by_nothing_else():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "quillspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_join_small_both_ways(spark):
    from quillspark.operators.joins import join_small

    big = spark.createDataFrame([(i, i % 3) for i in range(30)], "v int, k int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, n string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, join_small(big, small, ["k"], how).collect()), key=str)
        b = sorted(map(tuple, join_small(big, small, ["k"], how, limit=0).collect()), key=str)
        assert a == b
