"""Queries of manifests, catalogues, markup, audio and the pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..operators import manifest as m
from ..operators.extract import extract_chapters
from ..operators.segment import with_chunks
from ..session import fresh_path, spread, table
from ..sources import epub, wav
from ..streaming import folder
from . import oracles as o
from . import texts
from .pipeline import convert, current, inspect


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(table(spark, sf_dir, "chapters"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest manifest entry of each chapter, as an earlier manifest."""
    last = F.max(F.struct("written_at", "entry_id", "title", "text_hash", F.col("paragraphs").cast("bigint").alias("paragraphs"), "output", "status")).alias("l")
    rows = table(spark, sf_dir, "chapter_manifest").groupBy("book_id", F.col("spine_index").cast("bigint").alias("index")).agg(last)
    return rows.select("book_id", "index", "l.title", "l.text_hash", "l.paragraphs", "l.output", "l.status")


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.current_rows(table(spark, sf_dir, "chapters"))


def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as nested rows, summed up again from the nested chapters."""
    books = table(spark, sf_dir, "book_manifest").groupBy("book_id").agg(F.max("source").alias("source"), F.max("title").alias("title"))
    nested = m.book_manifests(manifest_rows(spark, sf_dir), books)
    total = F.aggregate("chapters", F.lit(0).cast("bigint"), lambda a, c: a + c["paragraphs"])
    return nested.select("book_id", F.size("chapters").alias("n_chapters"), total.alias("n_paragraphs"), F.get("chapters", 0)["index"].alias("first_index"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, percentage and progress line of each chapter in its book."""
    rows = m.positions(manifest_rows(spark, sf_dir).select("book_id", F.col("index").cast("int").alias("spine_index"), "title"))
    return rows.select("book_id", "spine_index", "ordinal", "n_chapters", "percent", m.progress_line("synthesize").alias("line"))


def resume_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows to go on with where a book has as many chapters as before."""
    return m.resume(manifest_rows(spark, sf_dir), _entries(spark, sf_dir)).select("book_id", "index", "text_hash", "output", "status")


def resume_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.resume(manifest_rows(spark, sf_dir), _entries(spark, sf_dir), by_hash=True).select("book_id", "index", "output", "status")


def pending_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current chapters without a done entry that has an output."""
    done = _entries(spark, sf_dir).where("status = 'done' AND output <> ''").select("book_id", "index")
    return m.pending(manifest_rows(spark, sf_dir), done).select("book_id", "index")


def manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with the output and status of the latest entries."""
    return m.update(manifest_rows(spark, sf_dir), _entries(spark, sf_dir)).select("book_id", "index", "output", "status")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.status_counts(_entries(spark, sf_dir))


def spine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored chapter with its manifest output, or 'missing'."""
    listed = _entries(spark, sf_dir).select("book_id", F.col("index").cast("int").alias("spine_index"), "output")
    found = table(spark, sf_dir, "chapters").select("chapter_id", "book_id", "spine_index").join(listed, ["book_id", "spine_index"], "left")
    return found.select("chapter_id", F.coalesce("output", F.lit("missing")).alias("output"))


def resource_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 item ids in byte order, with how often each occurs."""
    return table(spark, sf_dir, "chapters").where("item_id IS NOT NULL").groupBy("item_id").agg(F.count("*").alias("n")).orderBy("item_id").limit(50)


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spine items and distinct resources of every book."""
    return table(spark, sf_dir, "chapters").groupBy("book_id").agg(F.count("*").alias("spine_count"), F.countDistinct("item_id").alias("manifest_count"))


def markup_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter written as markup, its paragraphs as nested h2, p and li, and extracted again."""

    def escape(s):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")

    def placed(tag: str, at: int, inner: str) -> Column:
        chosen = F.filter(F.transform("paragraphs", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: F.pmod(x["i"], F.lit(4)) == at)
        return F.array_join(F.transform(chosen, lambda x: F.concat(F.lit(f"<{tag}><{inner}>"), escape(F.substring(x["p"], 1, 2)), F.lit(f"</{inner}>"), escape(F.substring(x["p"], F.lit(3), F.char_length(x["p"]))), F.lit(f"</{tag}>"))), "")

    body = F.concat(F.lit("<div><section>"), placed("p", 0, "em"), F.lit("</section><ul>"), placed("li", 1, "span"), F.lit("</ul>"), placed("h2", 2, "i"), placed("p", 3, "b"), F.lit("</div>"))
    html = F.concat(F.lit("<html><head><title>"), escape(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><h1>"), escape(F.coalesce("title", F.lit(""))), F.lit("</h1>"), body, F.lit("</body></html>"))
    rows = extract_chapters(spread(table(spark, sf_dir, "chapters").select("chapter_id", "item_id", html.alias("html"))), "html", "item_id")
    return rows.select("chapter_id", F.posexplode("paragraphs").alias("para_no", "text"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book's current chapters written as an e-book, and the archives read back."""
    target = fresh_path(spark, "epub")
    books = table(spark, sf_dir, "book_manifest").groupBy("book_id").agg(F.max("book_id").alias("title"))
    epub.write_epubs(_current(spark, sf_dir), books, target).write.format("noop").mode("overwrite").save()
    return epub.read_epub(spark, target)


def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every chapter of the archives."""
    rows = epub.chapters(_written(spark, sf_dir))
    return rows.select("book_id", "spine_index", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n").alias("text"))


def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive's spine with the file that an item names."""
    raw = _written(spark, sf_dir)
    listed = epub.resources(raw).withColumnRenamed("id", "idref")
    return epub.spine(raw).join(listed, ["book_id", "idref"], "left").select("book_id", "pos", "idref", F.coalesce("path", F.lit("missing")).alias("path"), "mime")


def epub_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives' catalogues say of themselves."""
    return epub.dump_opf(_written(spark, sf_dir)).select("manifest_count", "spine_count", "title")


def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to narrate, from manifest files and sound files in a folder: the manifests are written as JSON and
    read back; of the outputs that entries name, every third is missing and every third holds nothing but a header."""
    folder = fresh_path(spark, "files")
    books = table(spark, sf_dir, "book_manifest").groupBy("book_id").agg(F.max("source").alias("source"), F.max("title").alias("title"))
    path = F.concat(F.lit(f"{folder}/sound/"), F.sha2("book_id", 256), F.lit("/"), F.col("index").cast("string"), F.lit(".wav"))
    entries = _entries(spark, sf_dir).withColumn("output", F.when(F.col("output") != "", path).otherwise(F.col("output")))
    m.write_manifest_files(m.book_manifests(entries, books), f"{folder}/books").write.format("noop").mode("overwrite").save()
    spark.dataSource.register(wav.WavDataSource)
    sounds = entries.where("output <> '' AND index % 3 <> 0").select(F.col("output").alias("path"), F.when(F.col("index") % 3 == 1, F.lit(b"")).otherwise(F.lit(b"\0\1" * 8)).alias("pcm"), F.lit(24_000).alias("sample_rate"))
    sounds.write.format("wav").mode("append").option("folder", folder).save()
    rows = m.flat(m.read_manifests(spark, f"{folder}/books/*/manifest.json"))
    return m.pending(rows, m.done_rows(rows, m.listed_files(spark, f"{folder}/sound"))).select("book_id", "index", "status")


def tone_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, file size and seconds of each chapter if every paragraph were a chunk."""
    n = audio.chapter_samples(F.col("paragraphs"))
    size = n * 2 + audio.HEADER
    return table(spark, sf_dir, "chapters").select("chapter_id", n.alias("n_samples"), size.alias("n_bytes"), audio.duration_seconds(size).alias("seconds"))


def finished_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as signals, finished to 16 bits."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", audio.finish_samples(F.col("embedding"), 1000).alias("s"))
    return x.select("vec_id", F.posexplode("s").alias("i", "sample")).select("vec_id", "i", F.col("sample").cast("int").alias("sample"))


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("-X"), F.when(F.col("c_nationkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("@"), F.when(F.col("c_nationkey") % 3 == 1, F.lit("x")).otherwise(F.lit("1.5")))))
    return table(spark, sf_dir, "customer").select("c_custkey", audio.parse_voice(spec).alias("v")).select("c_custkey", "v.voice", "v.speed")


def inspect_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(table(spark, sf_dir, "chapters"))


def convert_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current chapters narrated by the tone engine at its usual rate; nothing is written."""
    results, _ = convert(_current(spark, sf_dir), engine="tone")
    return results.select("book_id", "index", "n_samples", "status")


def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every stored chapter as an engine is given them."""
    rows = with_chunks(spread(table(spark, sf_dir, "chapters").select("chapter_id", "paragraphs")))
    return rows.select("chapter_id", F.posexplode("chunks").alias("no", "chunk"))


def voice_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style that a voice has for texts of some length: an unknown voice takes the default's, a longer text the last."""
    pack = lambda k: F.array(*(F.array(F.array(F.lit(float(10 * k + i)), F.lit(0.5))) for i in range(3 + k)))
    packs = F.create_map(F.lit("building_x"), pack(1), F.lit("default"), pack(2))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("_x")).alias("voice"))
    return rows.select("c_custkey", F.get(audio.voice_style(packs, F.col("voice"), (F.col("c_custkey") % 8).cast("int"), "default"), 0).alias("style"), F.get(audio.voice_style(packs, F.col("voice"), F.lit(1)), 0).alias("known"))


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence between chunks, and samples for as many characters as a chunk may have."""
    return table(spark, sf_dir, "segment_config").select("config_id", F.size(audio.silence(audio.RATE, audio.PAUSE_MS)).alias("pause"), F.array_max(audio.silence(audio.RATE, 1)).cast("int").alias("loudest"), audio.tone_samples(F.col("max_chars_per_chunk")).alias("longest"))


def manifest_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the times that manifests get are RFC 3339 in UTC."""
    books = table(spark, sf_dir, "book_manifest").groupBy("book_id").agg(F.max("source").alias("source"), F.max("title").alias("title"))
    stamped = m.book_manifests(manifest_rows(spark, sf_dir), books)
    return stamped.select("book_id", "tool", F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z$").alias("rfc3339"))


def stream_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of all chapters, read as a stream."""
    at = fresh_path(spark, "stream")
    stored = table(spark, sf_dir, "chapters")
    place, _, name = stored.inputFiles()[0].rpartition("/")
    chapters = folder.arriving(spark, place, stored.schema, name if name == "chapters.parquet" else "*.parquet")
    folder.manifest_stream(chapters, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("book_id").agg(F.count("*").alias("n_rows"), F.sum("paragraphs").alias("n_paragraphs"))


_NOW = "now AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, spine_index ORDER BY loaded_at DESC, chapter_id DESC) AS r FROM chapters) WHERE r = 1)"
_ROWS = "rows_ AS (SELECT book_id, CAST(spine_index AS BIGINT) AS index, title, sha256(array_to_string(paragraphs, chr(10))) AS text_hash, CAST(len(paragraphs) AS BIGINT) AS paragraphs FROM now)"
_LAST = "last AS (SELECT book_id, CAST(spine_index AS BIGINT) AS index, text_hash, output, status FROM (SELECT *, row_number() OVER (PARTITION BY book_id, spine_index ORDER BY written_at DESC, entry_id DESC) AS r FROM chapter_manifest) WHERE r = 1)"
_POS = "pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY book_id) AS n_chapters FROM now)"
_TONE = "sum(24000 * 20 * least(greatest(length(p), 1), 200) // 1000)"
_FINISH = """WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
    b AS (SELECT vec_id, len(x) AS n, list_transform(x, lambda v: v - list_reduce(x, lambda s, t: s + t) / len(x)) AS y FROM a),
    c AS (SELECT vec_id, n, y, least(0.98::DOUBLE / list_max(list_transform(y, lambda v: abs(v))), 3.0::DOUBLE) AS g, least(10, n // 2) AS f FROM b),
    d AS (SELECT vec_id, n, g, f, unnest(y) AS v, unnest(range(n)) AS i FROM c)
    SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(trunc(v * g * CASE WHEN i < f THEN i / f::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN i >= n - f THEN (n - i) / f::DOUBLE ELSE 1.0::DOUBLE END * 32767) AS INTEGER) AS sample FROM d"""

QUERIES = {
    "manifest_rows": manifest_rows, "book_summaries": book_summaries, "progress": progress, "resume_by_count": resume_by_count, "resume_by_hash": resume_by_hash, "pending_by_status": pending_by_status,
    "manifest_update": manifest_update, "status_counts": status_counts, "spine_lookup": spine_lookup, "resource_listing": resource_listing, "catalogue_counts": catalogue_counts, "markup_chapters": markup_chapters,
    "epub_chapters": epub_chapters, "epub_spine": epub_spine, "epub_catalogue": epub_catalogue, "resume_files": resume_files, "chapter_chunks": chapter_chunks, "voice_styles": voice_styles, "pauses": pauses, "manifest_stamps": manifest_stamps, "tone_durations": tone_durations, "finished_signals": finished_signals, "parse_voices": voices, "inspect_chapters": inspect_chapters, "convert_chapters": convert_chapters, "stream_manifests": stream_manifests,
}
_WS = o.SPACE
_TITLED = f"""t AS (SELECT chapter_id, title, item_id, {o.trimmed('title')} AS a, {o.trimmed('item_id')} AS b, {o.trimmed('paragraphs[1]')} AS p FROM chapters),
    u AS (SELECT *, coalesce(a = '' OR lower(a) IN ('chapter', 'unknown', 'untitled') OR a = '未知', true) AS pa, coalesce(b = '' OR lower(b) IN ('chapter', 'unknown', 'untitled') OR b = '未知', true) AS pb FROM t),
    titled AS (SELECT chapter_id, CASE WHEN NOT pa THEN title WHEN NOT pb THEN item_id ELSE
        coalesce(nullif(regexp_replace({o.trimmed("substr(p, 1, 32)")}, '^[{_WS[1:-1]}。，,.；;：:]+|[{_WS[1:-1]}。，,.；;：:]+$', '', 'g'), ''), 'Chapter') END AS chosen FROM u)"""
_PARAS = "paras AS (SELECT chapter_id AS id, unnest(range(len(paragraphs))) AS no, unnest(list_transform(paragraphs, lambda p: coalesce(p, ''))) AS text FROM chapters)"
_PLAIN = f"WITH RECURSIVE {_PARAS}, {o.compatible('paras')}, flat AS (SELECT row_number() OVER () AS pid, id, no, {o.normalized('text')} AS text FROM kc)"
_SPOKEN = f"{_PLAIN}, conv AS (WITH {texts._converted('pid', 'text', 'flat', 'converted')} SELECT id AS pid, converted FROM out_), said AS (SELECT id, no, coalesce(converted, text) AS text FROM flat LEFT JOIN conv USING (pid)), {o.chunked('said')}"
ORACLES = {
    "manifest_rows": f"WITH {_NOW}, {_ROWS} SELECT *, CAST(NULL AS VARCHAR) AS output, 'parsed' AS status FROM rows_",
    "book_summaries": f"WITH {_NOW}, {_ROWS} SELECT b.book_id, CAST(count(index) AS INTEGER) AS n_chapters, CAST(coalesce(sum(paragraphs), 0) AS BIGINT) AS n_paragraphs, min(index) AS first_index FROM (SELECT DISTINCT book_id FROM book_manifest) b LEFT JOIN rows_ USING (book_id) GROUP BY b.book_id",
    "progress": f"WITH {_NOW}, {_POS}, p AS (SELECT *, CAST(round(100.0 * (ordinal + 1) / n_chapters) AS INTEGER) AS percent FROM pos) SELECT book_id, spine_index, ordinal, n_chapters, percent, '[' || (ordinal + 1) || '/' || n_chapters || ' ' || percent || '%] synthesize ' || coalesce(title, '') AS line FROM p",
    "resume_by_count": f"""WITH {_NOW}, {_ROWS}, {_LAST}, kept AS (SELECT book_id FROM (SELECT book_id, count(*) AS a FROM rows_ GROUP BY 1) JOIN (SELECT book_id, count(*) AS b FROM last GROUP BY 1) USING (book_id) WHERE a = b)
        SELECT book_id, index, text_hash, output, status FROM last SEMI JOIN kept USING (book_id) UNION ALL SELECT book_id, index, text_hash, NULL, 'parsed' FROM rows_ ANTI JOIN kept USING (book_id)""",
    "resume_by_hash": f"WITH {_NOW}, {_ROWS}, {_LAST} SELECT book_id, index, CASE WHEN lower(l.text_hash) = r.text_hash THEN l.output END AS output, CASE WHEN lower(l.text_hash) = r.text_hash THEN l.status ELSE 'parsed' END AS status FROM rows_ r LEFT JOIN last l USING (book_id, index)",
    "pending_by_status": f"WITH {_NOW}, {_ROWS}, {_LAST} SELECT book_id, index FROM rows_ ANTI JOIN (SELECT * FROM last WHERE status = 'done' AND output <> '') d USING (book_id, index)",
    "manifest_update": f"WITH {_NOW}, {_ROWS}, {_LAST} SELECT book_id, index, output, coalesce(status, 'parsed') AS status FROM rows_ LEFT JOIN last USING (book_id, index)",
    "status_counts": f"WITH {_LAST} SELECT book_id, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'parsed') AS n_parsed FROM last GROUP BY book_id",
    "spine_lookup": f"WITH {_LAST} SELECT chapter_id, coalesce(output, 'missing') AS output FROM chapters c LEFT JOIN last l ON l.book_id = c.book_id AND l.index = c.spine_index",
    "resource_listing": "SELECT item_id, count(*) AS n FROM chapters WHERE item_id IS NOT NULL GROUP BY item_id ORDER BY item_id LIMIT 50",
    "catalogue_counts": "SELECT book_id, count(*) AS spine_count, count(DISTINCT item_id) AS manifest_count FROM chapters GROUP BY book_id",
    "markup_chapters": f"""WITH x AS (SELECT chapter_id, list_transform(paragraphs, lambda p: trim(regexp_replace(p, '{_WS}+', ' ', 'g'))) AS l, trim(regexp_replace(coalesce(title, ''), '{_WS}+', ' ', 'g')) AS t, {o.trimmed("coalesce(title, '')")} AS h,
            {o.trimmed('paragraphs[3]')} AS second FROM chapters),
        w AS (SELECT *, CASE WHEN h <> '' THEN h ELSE coalesce(second, '') END AS heading FROM x),
        y AS (SELECT chapter_id, t, l, list_filter([t], lambda q: q <> '' AND q <> heading) AS h1, list_filter(list_transform(range(3, len(l) + 1, 4), lambda i: l[i]), lambda q: q <> '' AND q <> heading) AS h2,
            list_filter(list_concat(list_transform(range(1, len(l) + 1, 4), lambda i: l[i]), list_transform(range(4, len(l) + 1, 4), lambda i: l[i])), lambda q: q <> '') AS p, list_filter(list_transform(range(2, len(l) + 1, 4), lambda i: l[i]), lambda q: q <> '') AS li FROM w),
        z AS (SELECT chapter_id, list_concat(list_concat(h1, h2), list_concat(p, li)) AS m, trim(regexp_replace(t || array_to_string(list_concat(list_transform(range(1, len(l) + 1, 4), lambda i: l[i]), list_concat(list_transform(range(2, len(l) + 1, 4), lambda i: l[i]), list_concat(list_transform(range(3, len(l) + 1, 4), lambda i: l[i]), list_transform(range(4, len(l) + 1, 4), lambda i: l[i])))), ''), '{_WS}+', ' ', 'g')) AS whole FROM y),
        v AS (SELECT chapter_id, CASE WHEN len(m) > 0 THEN m WHEN whole <> '' THEN [whole] ELSE [] END AS m FROM z)
        SELECT chapter_id, CAST(unnest(range(len(m))) AS INTEGER) AS para_no, unnest(m) AS text FROM v""",
    "tone_durations": f"SELECT chapter_id, n AS n_samples, n * 2 + 44 AS n_bytes, n / 24000.0::DOUBLE AS seconds FROM (SELECT chapter_id, coalesce((SELECT CAST({_TONE} AS BIGINT) FROM unnest(paragraphs) u(p)), 0) + greatest(len(paragraphs) - 1, 0) * 3600 AS n FROM chapters)",
    "finished_signals": _FINISH,
    "parse_voices": "SELECT c_custkey, replace(lower(c_mktsegment), ' ', '') || '_x' AS voice, CASE WHEN c_nationkey % 3 = 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS speed FROM customer",
    "epub_chapters": f"""WITH {_NOW}, x AS (SELECT book_id, spine_index, list_filter(list_transform(paragraphs, lambda p: trim(regexp_replace(p, '{_WS}+', ' ', 'g'))), lambda p: p <> '') AS l FROM now)
        SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS INTEGER) AS spine_index, CAST(len(l) AS INTEGER) AS n_paragraphs, coalesce(array_to_string(l, chr(10)), '') AS text FROM x""",
    "epub_spine": f"""WITH {_NOW}, x AS (SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS n FROM now)
        SELECT book_id, CAST(n AS INTEGER) AS pos, coalesce(nullif(item_id, ''), 'c' || n) || '-' || n AS idref, 'OPS/c' || n || '.xhtml' AS path, 'application/xhtml+xml' AS mime FROM x""",
    "epub_catalogue": f"WITH {_NOW} SELECT CAST(count(*) AS INTEGER) AS manifest_count, CAST(count(*) AS INTEGER) AS spine_count, book_id AS title FROM now GROUP BY book_id",
    "resume_files": f"WITH {_LAST} SELECT book_id, index, status FROM last WHERE book_id IN (SELECT book_id FROM book_manifest) AND NOT coalesce(status = 'done' AND output <> '' AND index % 3 = 2, false)",
    "chapter_chunks": f"{_SPOKEN} SELECT id AS chapter_id, CAST(unnest(range(len(chunks))) AS INTEGER) AS no, unnest(chunks) AS chunk FROM chunks",
    "inspect_chapters": f"{_SPOKEN}, {_TITLED} SELECT book_id, spine_index, chapter_id, chosen AS title, CAST(len(paragraphs) AS INTEGER) AS n_paragraphs, CAST(coalesce(len(chunks), 0) AS INTEGER) AS n_chunks, {o.SAMPLES} AS n_samples FROM chapters JOIN titled USING (chapter_id) LEFT JOIN chunks ON chunks.id = chapter_id",
    "convert_chapters": f"{_PLAIN}, {o.chunked('flat')}, {_NOW} SELECT book_id, CAST(spine_index AS BIGINT) AS index, {o.SAMPLES} AS n_samples, 'done' AS status FROM now LEFT JOIN chunks ON chunks.id = chapter_id",
    "voice_styles": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 10.0 + least(greatest(c_custkey % 8, 1), 4) - 1 ELSE 20.0 + least(greatest(c_custkey % 8, 1), 5) - 1 END::DOUBLE AS style, CASE WHEN c_mktsegment = 'BUILDING' THEN 10.0::DOUBLE END AS known FROM customer""",
    "pauses": "SELECT config_id, 3600 AS pause, 0 AS loudest, CAST(480 * least(greatest(max_chars_per_chunk, 1), 200) AS BIGINT) AS longest FROM segment_config",
    "manifest_stamps": "SELECT DISTINCT book_id, 'quillspark' AS tool, true AS rfc3339 FROM book_manifest",
    "stream_manifests": "SELECT book_id, count(*) AS n_rows, CAST(sum(len(paragraphs)) AS BIGINT) AS n_paragraphs FROM chapters GROUP BY book_id",
}
