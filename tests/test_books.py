import io
import json
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import audio
from quillspark.operators import manifest as m
from quillspark.operators import speech
from quillspark.operators.extract import extract_chapters
from quillspark.operators.segment import cut_sentence, pack_pieces, with_chunks
from quillspark.plans.pipeline import convert, inspect, inspect_line
from quillspark.sources import epub

MARKUP = [
    ("<html><head></head><body><h1>第一章</h1><p>内容。</p></body></html>", "第一章", ["内容。"]),
    ("<title>T</title><body><p>a</p><h2>b</h2><li>c</li><p>d</p></body>", "T", ["a", "d", "c"]),
    ("<title>T</title><body><h1>A</h1><h1>B</h1><p>x</p><h2>A</h2></body>", "T", ["B", "x"]),
    ("<body><ul><li><p>x</p></li></ul></body>", "x", ["x", "x"]),
    ("<title>T</title><p>a<br>b</p>", "T", ["ab"]),
    ("<title>T</title><body><div>only</div></body>", "T", ["only"]),
    ("<title>T</title><body><h1>A</h1></body>", "T", ["A"]),
    ("<body><h1> </h1><h2>H</h2><p>x</p></body>", "H", ["x"]),
    ("<title>T</title><body><p>one<p>two<div>z</div><script>var a='</p>'</script></body>", "T", ["one", "two"]),
    (None, "Chapter", []),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(MARKUP)], "i int, html string")
    got = [(r["title"], list(r["paragraphs"])) for r in extract_chapters(df).orderBy("i").collect()]
    assert got == [(t, p) for _, t, p in MARKUP]
    one = extract_chapters(df.where("i = 1"), order="document").first()
    assert list(one["paragraphs"]) == ["a", "c", "d"]


def test_segments(spark):
    cases = [
        (["你好。世界！再见？"], 100, ["你好。 世界！ 再见？"]),
        (["一二三四五六七八九十，一二三四五六七八九十，一二三四五六七八九十。"], 12, ["一二三四五六七八九十,", "一二三四五六七八九十,", "一二三四五六七八九十。"]),
        (["甲" * 25], 10, ["甲" * 10, "甲" * 10, "甲" * 5]),
        (["甲。", "乙。"], 10, ["甲。 乙。"]), (["甲。", "乙。"], 4, ["甲。", "乙。"]), (["甲。", "乙。"], 5, ["甲。 乙。"]), ([], 10, []), (["  "], 10, []), ([None, "甲。"], 10, ["甲。"]),
    ]
    df = spark.createDataFrame([(i, p, n) for i, (p, n, _) in enumerate(cases)], "i int, paragraphs array<string>, n int")
    got = [list(r["chunks"]) for r in with_chunks(df, limit=F.col("n")).orderBy("i").collect()]
    assert got == [c for _, _, c in cases]
    assert with_chunks(spark.createDataFrame([(None,)], "paragraphs array<string>")).first()["chunks"] is None


def test_packing_is_tight_and_whole():
    rng = np.random.default_rng(0)
    sentences = ["".join(rng.choice(list("甲乙丙，、")) for _ in range(rng.integers(1, 60))) for _ in range(200)]
    chunks = pack_pieces(sentences, 20)
    assert all(0 < len(c) <= 20 for c in chunks)
    assert "".join(chunks).replace(" ", "") == "".join(sentences)
    assert all(len(p) <= 20 for s in sentences for p in cut_sentence(s, 20))


def test_finish(spark):
    cases = [([0.5, -0.5, 0.5, -0.5], [0, -32111, 32111, -32111]), ([float("nan"), 1.0], [0, 0]), ([], [])]
    for signal, want in cases:
        assert speech.finish(np.array(signal, np.float32), 100).tolist() == want
        df = spark.createDataFrame([(signal,)], "s array<float>")
        assert list(df.select(audio.finish_samples(F.col("s"), 100)).first()[0]) == want


def test_tone(spark):
    assert len(speech.ToneEngine(10_000).synthesize("你好")) == 400
    assert len(speech.ToneEngine().synthesize("x" * 80)) == 38_400
    chunks = ["x" * 80, "x" * 80, "x" * 40]
    samples = speech.chapter_audio(speech.ToneEngine(), chunks)
    assert len(samples) == 103_200
    assert spark.createDataFrame([(chunks,)], "c array<string>").select(audio.chapter_samples(F.col("c"))).first()[0] == 103_200
    data = speech.wav_bytes(samples, 24_000)
    assert len(data) == 206_444
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (24_000, 1, 2)
        assert np.array_equal(np.frombuffer(w.readframes(w.getnframes()), "<i2"), samples)
    assert spark.range(1).select(audio.silence(1000, 250), audio.duration_seconds(F.lit(206_444)), audio.duration_seconds(F.lit(44))).first()[1:] == (4.3, 0.0)
    with pytest.raises(ValueError):
        speech.build_engine("nobody")


def test_voices(spark):
    df = spark.createDataFrame([("auto",), ("ZF-Xiao Xiao@1.5",), ("",), ("zf_001@x",), (None,)], "s string")
    assert [tuple(r[0]) for r in df.select(audio.parse_voice(F.col("s"))).collect()] == [("zf_xiaoxiao", 1.0), ("zf_xiaoxiao", 1.5), ("zf_xiaoxiao", 1.0), ("zf_001", 1.0), ("zf_xiaoxiao", 1.0)]
    assert tuple(df.select(audio.parse_voice(F.col("s"), "v1.1")).collect()[2][0]) == ("zf_048", 1.0)
    assert [r[0][1] for r in df.select(audio.parse_voice(F.col("s"), preset="speed")).collect()] == [1.2, 1.5, 1.2, 1.2, 1.2]
    packs = F.create_map(F.lit("a"), F.array(F.array(F.array(F.lit(1.0))), F.array(F.array(F.lit(2.0)))))
    styles = [audio.voice_style(packs, F.lit(v), F.lit(n), d) for v, n, d in (("a", 1, None), ("a", 9, None), ("x", 0, "a"), ("x", 1, None))]
    assert list(spark.range(1).select(*styles).first()) == [[1.0], [2.0], [1.0], None]


def test_percent_and_files(spark):
    row = spark.range(1).select(audio.percent(F.lit(1), F.lit(16)), audio.percent(F.lit(2), F.lit(16)), m.not_empty(F.lit("a.WAV"), F.lit(44)), m.not_empty(F.lit("a.wav"), F.lit(45)), m.not_empty(F.lit("a.bin"), F.lit(1)), m.not_empty(F.lit("a"), F.lit(None).cast("int"))).first()
    assert tuple(row) == (6, 13, False, True, True, False)


def book(tmp_path, name="mini.epub", title="Mini 书"):
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ("one", "two", "gone"))
        z.writestr("OPS/b.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/">{title}</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="one"/><itemref idref="nowhere"/><itemref idref="two"/><itemref idref="gone"/></spine></package>')
        z.writestr("OPS/one.xhtml", '<?xml version="1.0" encoding="utf-8"?><html><head><title>Start</title></head><body><h1>Start</h1><p>你好。世界。</p></body></html>')
        z.writestr("OPS/two.xhtml", "<html><head><title>chapter</title></head><body><p>x</p></body></html>")


def test_epub(spark, tmp_path):
    book(tmp_path)
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    raw = epub.read_epub(spark, f"file://{tmp_path}").cache()
    assert raw.where("error IS NOT NULL").count() == 1
    assert [(r.book_id, r.title) for r in epub.books(raw).collect()] == [("Mini_书", "Mini 书")]
    rows = epub.chapters(raw).orderBy("spine_index").collect()
    assert [(r.spine_index, r.ordinal, r.title, list(r.paragraphs)) for r in rows] == [(0, 0, "Start", ["你好。世界。"]), (2, 1, "two", ["x"]), (3, 2, "gone", [])]
    assert epub.spine(raw).count() == 4 and epub.resources(raw).count() == 3
    assert epub.dump_opf(raw).where("manifest_count = 3 AND spine_count = 4").count() == 1
    spark.dataSource.register(epub.EpubDataSource)
    assert spark.read.format("epub").load(str(tmp_path)).where("error IS NULL").count() == 1


def test_convert_and_resume(spark, tmp_path):
    book(tmp_path)
    chapters = epub.chapters(epub.read_epub(spark, f"file://{tmp_path}")).cache()
    out = str(tmp_path / "out")
    results, rows = convert(chapters, folder=out, sample_rate=1000)
    results = results.cache()
    assert {(r.ordinal, r.status) for r in results.collect()} == {(0, "done"), (1, "done"), (2, "done")}
    done = m.update(rows, results)
    assert m.status_counts(done).first()["n_done"] == 3
    paths = m.write_manifest_files(m.book_manifests(done, epub.books(epub.read_epub(spark, f"file://{tmp_path}"))), out).collect()
    saved = json.load(open(paths[0]["path"]))
    assert [c["index"] for c in saved["chapters"]] == [0, 2, 3]
    earlier = m.flat(m.read_manifests(spark, paths[0]["path"]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    again, _ = convert(chapters, earlier, files, folder=out, sample_rate=1000)
    assert [r.ordinal for r in again.collect()] == [2]  # the empty chapter's file holds nothing
    lines = [r[0] for r in inspect(chapters.withColumn("chapter_id", F.col("spine_index"))).orderBy("spine_index").select(inspect_line()).collect()]
    assert lines[0] == "[001] Start | paragraphs: 1 | chunks: 1"


def _broken(monkeypatch, tmp_path):
    """An engine that workers can build: it fails for some texts."""
    (tmp_path / "breaking.py").write_text(
        "import numpy as np\nclass Engine:\n    sample_rate = 10\n    def synthesize(self, text):\n        if '坏' in text:\n            raise RuntimeError('no voice')\n        return np.ones(3, np.int16)\n"
        "def build(folder, voices, name, **options):\n    assert name == 'unconditioned' and voices is None\n    return Engine()\n"
    )
    for f in ("model.bin", "config.json", "tokenizer.json"):
        (tmp_path / f).write_text("{}")


def test_failed_chapter_goes_on(spark, tmp_path, monkeypatch):
    """A chapter that fails has status error and the message, and leaves no file and no record; the others go on."""
    _broken(monkeypatch, tmp_path)
    spark.sparkContext.addPyFile(str(tmp_path / "breaking.py"))
    rows = [(1, ["好", "好"], f"{tmp_path}/1.wav", f"{tmp_path}/1.json", "{}"), (2, ["坏"], f"{tmp_path}/2.wav", f"{tmp_path}/2.json", "{}"), (3, None, f"{tmp_path}/3.wav", f"{tmp_path}/3.json", "{}")]
    df = spark.createDataFrame(rows, "i int, chunks array<string>, path string, place string, note string")
    out = speech.synthesize_chapters(df, ["i"], "chunks", "path", "codec", 1000, record=("place", "note"), model_dir=str(tmp_path), voice="unconditioned", runtime="breaking:build")
    got = {r.i: (r.status, r.n_samples, r.error, r.output) for r in out.collect()}
    assert got == {1: ("done", 16, None, f"{tmp_path}/1.wav"), 2: ("error", 0, "RuntimeError: no voice", None), 3: ("done", 0, None, f"{tmp_path}/3.wav")}
    assert {p.name for p in tmp_path.glob("[123].*")} == {"1.wav", "1.json", "3.wav", "3.json"}


def test_engine_folders(tmp_path):
    with pytest.raises(FileNotFoundError, match="model.safetensors or model.bin, config.json, tokenizer.json"):
        speech.build_engine("codec", model_dir=str(tmp_path))
    with pytest.raises(FileNotFoundError, match="model.onnx, voices.bin, vocab.json"):
        speech.build_engine("onnx", model_dir=str(tmp_path))
    with pytest.raises(FileNotFoundError, match="index.json"):
        speech.voice_folder(str(tmp_path))
    (tmp_path / "index.json").write_text("{}")
    assert speech.voice_folder(str(tmp_path)) == str(tmp_path)
    (tmp_path / "voices").mkdir()
    (tmp_path / "voices/index.json").write_text("{}")
    assert speech.voice_folder(str(tmp_path)) == str(tmp_path / "voices")
    with pytest.raises(ValueError, match="unknown engine"):
        speech.build_engine("none")
    assert speech.engine_options("tone", "x", "y", 100) == {"sample_rate": 100} and speech.engine_options("onnx", "x", None) == {"model_dir": "x"}


def test_voice_file():
    def varint(n):
        return bytes([n]) if n < 251 else bytes([251]) + n.to_bytes(2, "little")

    packs = {"zf_xiaoxiao": np.arange(600, dtype="<f4").reshape(2, 1, 300), "b": np.ones((3, 1, 4), "<f4")}
    data = varint(len(packs)) + b"".join(varint(len(n)) + n.encode() + varint(len(p)) + b"".join(varint(len(r)) + b"".join(varint(len(v)) + v.tobytes() for v in r) for r in p) for n, p in packs.items())
    got = speech.read_voices(data)
    assert {n: p.tolist() for n, p in got.items()} == {n: p.tolist() for n, p in packs.items()}
    assert speech.style_row(got["b"], 9).shape == (1, 4)
    with pytest.raises(ValueError):
        speech.read_voices(data + b"x")


def test_voice_spec_is_that_of_the_columns(spark):
    specs = ["", "auto", " Af-Sky @1.5", "x@", "x@y", "x@2", "a b"]
    for generation in ("v1.0", "v1.1"):
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").select("i", audio.parse_voice(F.col("s"), generation).alias("v")).orderBy("i").collect()
        assert [(r.v.voice, r.v.speed) for r in rows] == [speech.voice_spec(s, generation) for s in specs]


def test_command_line(tmp_path, capsys, spark):
    from quillspark.cli import main

    book(tmp_path)
    path, out = f"file://{tmp_path}", str(tmp_path / "cli")
    assert main(["convert", path, "--out", out, "--sample-rate", "1000", "--jobs", "2"]) == 0
    said = capsys.readouterr().out
    assert said.startswith("[1/3 33%] done Start (") and "parsed: 3 chapters" in said
    main(["convert", path, "--out", out, "--sample-rate", "1000", "--resume"])
    assert capsys.readouterr().out.splitlines()[0] == "[3/3 100%] done gone (0.0s)"
    main(["inspect", path, "--head", "1"])
    said = capsys.readouterr().out
    assert "chapters: 3\n[001] Start | paragraphs: 1 | chunks: 1" in said and "[003]" not in said
    main(["dump-opf", path])
    assert "spine_items: 4" in capsys.readouterr().out
    main(["debug-spine", path])
    assert "spine: 4" in (said := capsys.readouterr().out) and "[01] idref=nowhere missing in resources" in said
    main(["list-zip", path, "--head", "1"])
    assert "resources: 3\nspine: 4\n[0000] gone | path=OPS/gone.xhtml" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["convert", path, "--max-chars", "-1"])


def test_a_run_that_died_is_taken_up(tmp_path, capsys, spark):
    """Without a manifest the workers' records tell what is done."""
    from quillspark.cli import main

    book(tmp_path)
    path, out = f"file://{tmp_path}", tmp_path / "cli"
    main(["convert", path, "--out", str(out), "--sample-rate", "1000"])
    (manifest,) = out.glob("*/manifest.json")
    first = json.loads(manifest.read_text())["chapters"]
    manifest.unlink()
    (next(out.glob("*/progress/2.json"))).unlink()  # the run died before this chapter
    capsys.readouterr()
    main(["convert", path, "--out", str(out), "--sample-rate", "1000", "--resume"])
    said = [line for line in capsys.readouterr().out.splitlines() if line.startswith("[")]
    assert [line[:5] for line in said] == ["[2/3 ", "[3/3 "]  # and the empty chapter, whose file holds nothing
    assert json.loads(manifest.read_text())["chapters"] == first


def test_wav_sink(spark, tmp_path):
    from quillspark.sources.wav import WavDataSource

    spark.dataSource.register(WavDataSource)
    rows = [("a/1.wav", np.arange(5, dtype="<i2").tobytes(), 100), ("b.wav", b"", 100), (None, b"", 1)]
    spark.createDataFrame(rows, "path string, pcm binary, sample_rate int").write.format("wav").mode("append").option("folder", str(tmp_path)).save()
    with wave.open(str(tmp_path / "a/1.wav")) as w:
        assert w.getnframes() == 5 and w.getframerate() == 100
    assert (tmp_path / "b.wav").stat().st_size == 44
    assert not list(tmp_path.rglob("*.tmp"))


def test_convert_query_has_the_usual_rate(spark, tmp_path):
    from quillspark.plans import books

    rows = [(1, "b", 0, "One", "i", ["你好。", "x" * 200]), (2, "b", 1, "Two", "i", [])]
    schema = "chapter_id long, book_id string, spine_index int, title string, item_id string, paragraphs array<string>"
    spark.createDataFrame(rows, schema).withColumn("loaded_at", F.current_timestamp()).write.parquet(f"{tmp_path}/chapters.parquet")
    got = {r["index"]: (r.n_samples, r.status) for r in books.convert_chapters(spark, str(tmp_path)).collect()}
    # 480 samples a character; chunks of 3, 160 and 40 characters and two pauses of 150 ms
    assert got == {0: (480 * 203 + 2 * 3600, "done"), 1: (0, "done")}
