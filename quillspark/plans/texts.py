"""Queries of the text, number and title scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerals, text, titles
from ..functions.register import register
from ..session import table
from . import oracles as o

_WS = o.SPACE


def _documents(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, clean=text.normalize_whitespace(F.col("text")), n_chars=text.char_count(F.col("text")))


def punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, wide=text.widen_punctuation(F.col("text")))


def soft_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last soft break of each text is, and the text before and after it; all of it comes before if there
    is none."""
    at = text.last_soft_break(F.col("text"))
    before, after = text.split_at(F.col("text"), F.coalesce(at, F.char_length("text")))
    return _documents(spark, sf_dir, position=at, before=before, after=after)


def soft_break_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the whole text, as the cutting of overlong sentences goes on: the piece and where its soft
    break is, null if it was cut at 160 characters or is the rest. Empty and null texts have no rows."""
    pieces = _documents(spark, sf_dir, p=text.soft_pieces(F.col("text"), 160)).select("doc_id", F.size("p").alias("n"), F.posexplode("p").alias("no", "piece"))
    size = F.char_length("piece")
    soft = F.right("piece", F.lit(1)).isin(*text.SOFT_BREAKS) & ((F.col("no") < F.col("n") - 1) | (size == 160))
    return pieces.select("doc_id", "no", F.when(soft, size).alias("position"), "piece")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, s=text.split_sentences(F.col("text"))).select("doc_id", F.posexplode("s").alias("no", "sentence"))


def compatibility_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, kc=text.nfkc(F.col("text")))


def speech_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as an engine is given them: form KC, white space, wide punctuation, figures as numerals."""
    return _documents(spark, sf_dir, spoken=numerals.normalize_for_speech(F.col("text")))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys, and prices as decimals, in numerals."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select("o_orderkey", numerals.number_to_zh(F.col("o_orderkey").cast("string")).alias("key_zh"), numerals.convert_numbers(F.concat(price, F.lit(" "), (F.col("o_custkey") % 101).cast("string"), F.lit("%"), F.year("o_orderdate").cast("string"), F.lit("年"))).alias("text_zh"))


def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, converted=numerals.convert_numbers(F.col("text")))


def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", titles.is_placeholder(F.col("title")).alias("placeholder"), titles.choose_title(F.col("title"), F.col("item_id"), F.col("paragraphs")).alias("chosen"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book ids, file stems and WAV paths of the manifests."""
    return table(spark, sf_dir, "book_manifest").select(
        "manifest_id", titles.safe_book_id(F.col("title"), F.col("source")).alias("safe_id"), titles.file_stem(F.col("source")).alias("stem"), titles.wav_path("out", (F.col("manifest_id") % 2000).cast("int"), F.coalesce("title", F.lit(""))).alias("path")
    )


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions, called from SQL over every chapter."""
    register(spark)
    table(spark, sf_dir, "chapters").createOrReplaceTempView("quill_chapters")
    return spark.sql("""SELECT chapter_id, quill_choose_title(title, item_id, paragraphs) AS chosen, quill_is_placeholder(title) AS placeholder, quill_whitespace(title) AS clean, quill_widen(title) AS wide,
        quill_char_count(title) AS n_chars, quill_figures(title) AS figures, quill_text_hash(paragraphs) AS text_hash, quill_tone_samples(coalesce(char_length(title), 0), 24000) AS samples,
        quill_pause_samples(size(coalesce(paragraphs, array()))) AS pauses, quill_duration(chapter_id, 24000) AS seconds, quill_percent(spine_index % 7 + 1, 7) AS percent, quill_last_soft_break(title) AS soft_break FROM quill_chapters""")


def _groups(source: str) -> str:
    """CTEs from ``num(id, no, digits)`` to ``zh(id, no, digits, read)``."""
    d = "substr(g, {0}, 1)"
    z = "translate(" + d + ", '0123456789', '零一二三四五六七八九')"
    a, b, c, e = (d.format(i) for i in (1, 2, 3, 4))
    read = (
        f"CASE WHEN {a} <> '0' THEN {z.format(1)} || '千' ELSE '' END || CASE WHEN {b} <> '0' THEN {z.format(2)} || '百' ELSE '' END || "
        f"CASE WHEN {c} = '0' THEN '' ELSE CASE WHEN {a} <> '0' AND {b} = '0' THEN '零' ELSE '' END || CASE WHEN {a} = '0' AND {b} = '0' AND {c} = '1' THEN '十' ELSE {z.format(3)} || '十' END END || "
        f"CASE WHEN {e} = '0' THEN '' ELSE CASE WHEN {c} = '0' AND (g[1] <> '0' OR g[2] <> '0') THEN '零' ELSE '' END || {z.format(4)} END"
    )
    return f"""
    {source},
    plain AS (SELECT DISTINCT digits, ltrim(digits, '0') AS p FROM num),
    parts AS (SELECT digits, p, k, substr(lpad(p, 16, '0'), 4 * k + 1, 4) AS g, ['兆', '亿', '万', ''][k + 1] AS unit FROM plain, range(4) t(k) WHERE length(p) BETWEEN 1 AND 16),
    said AS (SELECT digits, k, g, unit, {read} AS r FROM parts WHERE g <> '0000'),
    joined AS (SELECT digits, string_agg(CASE WHEN g LIKE '0%' AND k > first THEN '零' ELSE '' END || r || unit, '' ORDER BY k) AS r
               FROM (SELECT *, min(k) OVER (PARTITION BY digits) AS first FROM said) GROUP BY digits),
    zh AS (SELECT digits, CASE WHEN p = '' THEN '零' WHEN length(p) > 16 THEN translate(p, '0123456789', '零一二三四五六七八九') ELSE r END AS read FROM plain LEFT JOIN joined USING (digits))"""


_TOKEN_READ = """CASE WHEN NOT regexp_matches(tok, '^[0-9]') THEN tok
    WHEN contains(tok, '.') THEN read || '点' || translate(split_part(tok, '.', 2), '0123456789', '零一二三四五六七八九')
    WHEN tok LIKE '%\\%' ESCAPE '\\' THEN '百分之' || read
    WHEN tok LIKE '%年' THEN translate(tok, '0123456789', '零一二三四五六七八九') ELSE read END"""
_TOKENS = r"[0-9]+\.[0-9]+|[0-9]+%|[0-9]{4}年|[0-9]+|[^0-9]+"


_DOCS = "docs AS (SELECT doc_id AS id, 0 AS no, text FROM documents)"


def _converted(ids: str, body: str, relation: str, out: str) -> str:
    toks = f"toks AS (SELECT id, unnest(l) AS tok, unnest(range(len(l))) AS no FROM (SELECT {ids} AS id, regexp_extract_all({body}, '{_TOKENS}') AS l FROM {relation}))"
    num = f"{toks}, num AS (SELECT id, no, regexp_extract(tok, '^[0-9]+') AS digits FROM toks)"
    return f"{_groups(num)}, out_ AS (SELECT id, string_agg({_TOKEN_READ}, '' ORDER BY no) AS {out} FROM toks LEFT JOIN zh ON zh.digits = regexp_extract(tok, '^[0-9]+') GROUP BY id)"




def _clean(s: str) -> str:
    return f"regexp_replace({s}, '^{_WS}+|{_WS}+$', '', 'g')"


# Marks that count as alphabetic, in the scripts that titles use.
_ALNUM = r"\p{L}\p{N}\x{5B0}-\x{5BD}\x{5BF}\x{5C1}\x{5C2}\x{5C4}\x{5C5}\x{5C7}\x{610}-\x{61A}\x{64B}-\x{657}\x{659}-\x{65F}\x{670}\x{6D6}-\x{6DC}\x{6E1}-\x{6E4}\x{6E7}\x{6E8}\x{6ED}\x{900}-\x{903}\x{93A}\x{93B}\x{93E}-\x{94C}\x{94E}\x{94F}\x{955}-\x{957}\x{962}\x{963}\x{E31}\x{E34}-\x{E3A}\x{E4D}\x{24B6}-\x{24E9}\x{345}"

QUERIES = {
    "normalize_whitespace": whitespace, "widen_punctuation": punctuation, "soft_breaks": soft_breaks, "soft_break_pieces": soft_break_pieces, "split_sentences": sentences, "compatibility_form": compatibility_form, "speech_form": speech_form,
    "number_to_zh": numbers, "convert_numbers": numbers_in_text, "chapter_titles": chapter_titles, "safe_names": names, "sql_functions": sql_functions,
}
ORACLES = {
    "normalize_whitespace": f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS clean, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "widen_punctuation": "SELECT doc_id, translate(text, '!?;:', '！？；：') AS wide FROM documents",
    "soft_breaks": """SELECT doc_id, CAST(CASE WHEN n > 0 THEN n END AS INTEGER) AS position, substr(text, 1, k) AS before, substr(text, k + 1) AS after
        FROM (SELECT doc_id, text, n, CASE WHEN n > 0 THEN n ELSE length(text) END AS k FROM (SELECT doc_id, text, length(regexp_extract(text, '(?s)^(.*[，,、；;：:])', 1)) AS n FROM documents))""",
    "soft_break_pieces": """WITH RECURSIVE w(doc_id, no, rest, piece, position) AS (
            SELECT doc_id, -1, text, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM documents
            UNION ALL SELECT doc_id, no + 1, substr(rest, n + 1), substr(rest, 1, n), CASE WHEN soft > 0 THEN soft END FROM (
                SELECT *, CASE WHEN soft > 0 THEN soft ELSE 160 END AS n FROM (SELECT *, length(regexp_extract(substr(rest, 1, 160), '(?s)^(.*[，,、；;：:])', 1)) AS soft FROM w WHERE length(rest) >= 160)))
        SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(position AS INTEGER) AS position, piece FROM w WHERE piece IS NOT NULL
        UNION ALL SELECT doc_id, CAST(no + 1 AS INTEGER), CAST(NULL AS INTEGER), rest FROM w WHERE length(rest) BETWEEN 1 AND 159""",
    "split_sentences": f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS no, unnest(l) AS sentence FROM
        (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [{o.trimmed('text')}] END AS l FROM (SELECT doc_id, text, {o.sentence_list('text')} AS s FROM documents))""",
    "compatibility_form": f"WITH {_DOCS}, {o.compatible('docs')} SELECT id AS doc_id, text AS kc FROM kc",
    "speech_form": f"WITH {_DOCS}, {o.compatible('docs')}, plain AS (SELECT id AS pid, {o.normalized('text')} AS text FROM kc), conv AS (WITH {_converted('pid', 'text', 'plain', 'converted')} SELECT * FROM out_) SELECT pid AS doc_id, CASE WHEN text = '' THEN '' ELSE converted END AS spoken FROM plain LEFT JOIN conv ON conv.id = pid",
    "number_to_zh": f"""WITH k AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS digits FROM orders),
        kz AS (WITH {_groups('num AS (SELECT id, 0 AS no, digits FROM k)')} SELECT digits, read FROM zh),
        tz AS (WITH {_converted('o_orderkey', "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' || CAST(o_custkey % 101 AS VARCHAR) || '%' || CAST(year(o_orderdate) AS VARCHAR) || '年'", 'orders', 'text_zh')} SELECT id, text_zh FROM out_)
        SELECT k.id AS o_orderkey, kz.read AS key_zh, tz.text_zh FROM k JOIN kz USING (digits) JOIN tz ON tz.id = k.id""",
    "convert_numbers": f"WITH {_converted('doc_id', 'text', 'documents', 'converted')} SELECT d.doc_id, CASE WHEN d.text = '' THEN '' ELSE converted END AS converted FROM documents d LEFT JOIN out_ ON out_.id = d.doc_id",
    "chapter_titles": f"""WITH t AS (SELECT chapter_id, title, item_id, {_clean('title')} AS a, {_clean('item_id')} AS b, {_clean('paragraphs[1]')} AS p FROM chapters),
        u AS (SELECT *, coalesce(a = '' OR lower(a) IN ('chapter', 'unknown', 'untitled') OR a = '未知', true) AS pa, coalesce(b = '' OR lower(b) IN ('chapter', 'unknown', 'untitled') OR b = '未知', true) AS pb FROM t)
        SELECT chapter_id, pa AS placeholder, CASE WHEN NOT pa THEN title WHEN NOT pb THEN item_id ELSE
            coalesce(nullif(regexp_replace({_clean("substr(p, 1, 32)")}, '^[{_WS[1:-1]}。，,.；;：:]+|[{_WS[1:-1]}。，,.；;：:]+$', '', 'g'), ''), 'Chapter') END AS chosen FROM u""",
    "sql_functions": f"""WITH t AS (SELECT *, {_clean('title')} AS a, {_clean('item_id')} AS b, {_clean('paragraphs[1]')} AS p FROM chapters),
        u AS (SELECT *, coalesce(a = '' OR lower(a) IN ('chapter', 'unknown', 'untitled') OR a = '未知', true) AS pa, coalesce(b = '' OR lower(b) IN ('chapter', 'unknown', 'untitled') OR b = '未知', true) AS pb FROM t)
        SELECT chapter_id, pa AS placeholder, CASE WHEN NOT pa THEN title WHEN NOT pb THEN item_id ELSE
            coalesce(nullif(regexp_replace({_clean("substr(p, 1, 32)")}, '^[{_WS[1:-1]}。，,.；;：:]+|[{_WS[1:-1]}。，,.；;：:]+$', '', 'g'), ''), 'Chapter') END AS chosen,
            trim(regexp_replace(title, '{_WS}+', ' ', 'g')) AS clean, translate(title, '!?;:', '！？；：') AS wide, CAST(length(title) AS INTEGER) AS n_chars, translate(title, '0123456789', '零一二三四五六七八九') AS figures,
            sha256(array_to_string(coalesce(paragraphs, []), chr(10))) AS text_hash, CAST(480 * least(greatest(coalesce(length(title), 0), 1), 200) AS BIGINT) AS samples, CAST(3600 * greatest(coalesce(len(paragraphs), 0) - 1, 0) AS BIGINT) AS pauses,
            CASE WHEN chapter_id > 44 THEN (chapter_id - 44) / 2.0::DOUBLE / 24000 ELSE 0.0::DOUBLE END AS seconds, CAST(round(100.0::DOUBLE * (spine_index % 7 + 1) / 7) AS INTEGER) AS percent,
            CAST(nullif(length(regexp_extract(title, '(?s)^(.*[，,、；;：:])', 1)), 0) AS INTEGER) AS soft_break FROM u""",
    "safe_names": f"""WITH t AS (SELECT manifest_id, {_clean('title')} AS a, title, regexp_replace(split_part(source, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM book_manifest)
        SELECT manifest_id, regexp_replace(coalesce(nullif(a, ''), nullif(stem, ''), 'book'), '[^{_ALNUM}_-]', '_', 'g') AS safe_id, stem,
            'out/' || printf('%03d', manifest_id % 2000) || '_' ||
            CASE WHEN regexp_matches(n, '^[_ ]*$') THEN 'chapter' ELSE n END || '.wav' AS path
        FROM (SELECT *, {_clean(f"regexp_replace(coalesce(title, ''), '[^{_ALNUM} _-]', '_', 'g')")} AS n FROM t)""",
}
