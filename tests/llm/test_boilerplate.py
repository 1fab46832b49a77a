from quillspark.llm.boilerplate import find_repeated, remove_lines

SCHEMA = "id long, source string, lines array<string>, key string, nodes int"


def rows():
    out = []
    for i in range(60):
        out.append((i, "s", [f"only {chr(97 + i % 26)}{'x' * i}", "© Shared 12!", "Read by", None, "—"] if i % 2 else [f"text {'y' * i}"], "k", 1))
    out += [(100 + i, "t", ["Shared"] if i < 4 else ["z" * (i + 1)], "k", 1) for i in range(10)]  # four of ten are too few
    out += [(200, None, ["shared", "read by"], "k", 1), (201, "s", None, "k", 1), (202, "s", [], "k", 1), (1, "s", ["shared 9"], "k", 1)]
    return out


def test_found_and_removed(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    matches, blocks = find_repeated(df, "id", "source", "lines")
    got = sorted((r.doc, r.line_no) for r in matches.collect())
    assert got == sorted([(i, k) for i in range(60) if i % 2 for k in (1, 2)] + [(1, 0)])
    assert len({r.block for r in blocks.collect()}) == 1 and blocks.count() == 2
    left = remove_lines(df.where("id = 3"), "id", "lines", matches).first()
    assert left.lines == ["only dxxx", None, "—"] and left.key == "k"


def test_empty(spark):
    matches, blocks = find_repeated(spark.createDataFrame([], SCHEMA), "id", "source", "lines")
    assert matches.count() == 0 and blocks.count() == 0


def test_share_counts_all_documents(spark):
    few = [(i, "s", ["line"] if i < 8 else ["z" * (i + 1)], "k", 1) for i in range(100)]
    assert find_repeated(spark.createDataFrame(few, SCHEMA), "id", "source", "lines")[0].count() == 8
    assert find_repeated(spark.createDataFrame([*few, (900, "s", [], "k", 1)], SCHEMA), "id", "source", "lines")[0].count() == 0
