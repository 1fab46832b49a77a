import os

import pytest
from plans_of import shuffled

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "p9_found"])
def test_no_text_is_shuffled(spark, monkeypatch, name):
    """The whole plan, nothing cut out of it and no side small enough for a worker, moves no array of texts."""
    from quillspark.llm import boilerplate, encodings, queries_lookalike, queries_split, registry
    from quillspark.operators import joins

    monkeypatch.setattr(joins, "fits", lambda *a, **k: False)
    monkeypatch.setattr(encodings, "ITERATIONS", 1)
    for module in (boilerplate, encodings, queries_lookalike, queries_split):
        monkeypatch.setattr(module, "cut", lambda df, name: df)
    moved = shuffled(registry.queries()[name](spark, SF))
    assert "array<string>" not in moved, moved
    assert moved or name == "p9_found"
