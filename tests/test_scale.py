import os

import pytest
from plans_of import shuffled

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["manifest_rows", "progress", "resume_by_hash", "resume_by_count", "manifest_update", "book_summaries", "status_counts"])
def test_no_text_is_shuffled(spark, monkeypatch, name):
    """Also where no side fits on a worker."""
    from quillspark.operators import joins
    from quillspark.plans import registry

    monkeypatch.setattr(joins, "fits", lambda *a, **k: False)
    moved = shuffled(registry.queries()[name](spark, SF))
    assert moved and "array<string>" not in moved


def test_text_that_is_shuffled_is_seen(spark):
    df = spark.createDataFrame([(1, ["a"])], "i int, paragraphs array<string>")
    assert "array<string>" in shuffled(df.repartition(2, "i"))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillspark import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,3000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_what_fits_is_told_by_rows_and_bytes(spark):
    from quillspark.operators.joins import fits

    df = spark.createDataFrame([("x" * 1000, [1] * 100, None)] * 10, "s string, a array<int>, m map<string,int>")
    assert fits(df) and not fits(df, rows=9) and not fits(df, size=10 * (1000 + 3200) - 1) and fits(df, size=10 * (1000 + 3200))
    assert fits(df.limit(0), 0, 0)
