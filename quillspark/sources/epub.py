"""E-books as tables: books, spine, resources and chapters.

Files are listed and read by Spark's binaryFile source, from any file system it knows, one row per book; the
archive is opened in the worker. ``EpubDataSource`` offers the same as spark.read.format("epub").
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.titles import file_stem, safe_book_id, strip
from ..operators.extract import extract_chapters

BOOK = "path string, title string, error string, rootfile string, spine array<string>, resources array<struct<id:string,path:string,mime:string>>, documents array<struct<pos:int,idref:string,html:string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_archive(path: str, data: bytes, with_text: bool = True) -> dict:
    """What one file holds. A file that can't be opened has an error and nothing else."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        root = next(unquote(e.get("full-path")) for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(root))
        base = posixpath.dirname(root)
        title = next(("".join(e.itertext()) for e in package.iter() if _local(e.tag) == "title"), None)
        items = [(e.get("id"), posixpath.normpath(posixpath.join(base, unquote(e.get("href", "")))), e.get("media-type")) for e in package.iter() if _local(e.tag) == "item"]
        spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"]
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        return {"path": path, "title": None, "error": f"{type(e).__name__}: {e}", "rootfile": None, "spine": [], "resources": [], "documents": []}
    where = {i: p for i, p, _ in items}
    documents = []
    if with_text:
        for pos, idref in enumerate(spine):
            if idref in where:
                try:
                    html = z.read(where[idref]).decode("utf-8", "replace")
                except KeyError:
                    html = ""  # listed but missing: an empty chapter
                documents.append({"pos": pos, "idref": idref, "html": re.sub(r"^\s*<\?xml[^>]*\?>", "", html)})
    return {"path": path, "title": title, "error": None, "rootfile": root, "spine": spine, "resources": [{"id": i, "path": p, "mime": m} for i, p, m in items], "documents": documents}


def read_epub(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """One row per file under ``path`` (a folder or a pattern), see ``BOOK``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):  # a book at a time
                yield pd.DataFrame([read_archive(p, data, with_text)])

    return reader.load(path).select("path", "content").mapInPandas(run, BOOK)


def _keyed(raw: DataFrame) -> DataFrame:
    """Readable books with book_id and book_title, from their own row. A blank title gives way to the file's name."""
    stem = file_stem(F.col("path"))
    title = F.when(strip(F.col("title")) != "", F.col("title")).when(stem != "", stem).otherwise(F.lit("Book"))
    return raw.where("error IS NULL").withColumn("book_title", title).withColumn("book_id", safe_book_id(F.col("book_title"), F.col("path")))


def books(raw: DataFrame) -> DataFrame:
    """book_id, title, source."""
    return _keyed(raw).select("book_id", F.col("book_title").alias("title"), F.col("path").alias("source"))


def spine(raw: DataFrame) -> DataFrame:
    return _keyed(raw).select("book_id", F.posexplode("spine").alias("pos", "idref"))


def resources(raw: DataFrame) -> DataFrame:
    return _keyed(raw).select("book_id", F.explode("resources").alias("r")).select("book_id", "r.id", "r.path", "r.mime")


def heads(raw: DataFrame) -> DataFrame:
    """book_id, book_title, and the numbers of its spine items, resources and chapters."""
    known = F.transform("resources", lambda r: r["id"])
    found = F.size(F.filter("spine", lambda s: F.array_contains(known, s)))
    return _keyed(raw).select("book_id", "book_title", F.size("spine").alias("spine_count"), F.size("resources").alias("manifest_count"), found.alias("n_chapters"))


def chapters(raw: DataFrame, order: str = "tag", head: int | None = None) -> DataFrame:
    """book_id, spine_index, ordinal, item_id, title, paragraphs, extracted_title; unresolvable spine items have none.
    With ``head`` only so many of each book are taken out of its archive's list."""
    keyed = _keyed(raw) if head is None else _keyed(raw).withColumn("documents", F.slice("documents", 1, head))
    docs = keyed.select("book_id", F.posexplode("documents").alias("ordinal", "d")).select("book_id", F.col("d.pos").alias("spine_index"), "ordinal", F.col("d.idref").alias("item_id"), F.col("d.html").alias("html"))
    return extract_chapters(docs, "html", "item_id", order)


def dump_opf(raw: DataFrame) -> DataFrame:
    """Catalogue facts: the package file, numbers of manifest and spine items, title as it stands."""
    return raw.select("path", "rootfile", F.size("resources").alias("manifest_count"), F.size("spine").alias("spine_count"), F.coalesce("title", F.lit("")).alias("title"))


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Reader(DataSourceReader):
    """Lists a folder or a pattern of its last part on any file system that pyarrow knows; a task reads a book."""

    def __init__(self, options: dict):
        from fnmatch import fnmatch

        from pyarrow import fs

        store, inner = _store(options["path"])
        head = options["path"][: len(options["path"]) - len(inner)]
        info = store.get_file_info(inner)
        folder, pattern = (inner, "*.epub") if info.type == fs.FileType.Directory else (posixpath.dirname(inner), posixpath.basename(inner))
        found = store.get_file_info(fs.FileSelector(folder, recursive=info.type == fs.FileType.Directory, allow_not_found=True))
        self.paths = sorted(head + f.path for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))

    def partitions(self) -> list[InputPartition]:
        return [_Slice([p]) for p in self.paths] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        from pyspark.sql import Row

        for p in partition.paths:
            store, inner = _store(p)
            with store.open_input_file(inner) as f:
                x = read_archive(p, f.read())
            yield (x["path"], x["title"], x["error"], x["rootfile"], x["spine"], [Row(**r) for r in x["resources"]], [Row(**d) for d in x["documents"]])


class EpubDataSource(DataSource):
    """spark.dataSource.register(EpubDataSource); spark.read.format("epub").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return BOOK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def write_epubs(chapters: DataFrame, books: DataFrame, folder: str) -> DataFrame:
    """<folder>/<book_id>.epub for each book, from chapters (book_id, spine_index, item_id, title, paragraphs)."""
    from html import escape

    from ..operators.speech import write_file

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        title, book = pdf["book_title"].iloc[0] or "", pdf["book_id"].iloc[0]
        rows = pdf.sort_values("spine_index", kind="stable")
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
            items, refs = [], []
            for n, r in enumerate(rows.to_dict("records")):
                z.writestr(f"OPS/c{n}.xhtml", "<html><head><title>%s</title></head><body>%s</body></html>" % (escape(r["title"] or ""), "".join(f"<p>{escape(p)}</p>" for p in r["paragraphs"] if p is not None)))
                items.append(f'<item id="{escape(r["item_id"] or f"c{n}")}-{n}" href="c{n}.xhtml" media-type="application/xhtml+xml"/>')
                refs.append(f'<itemref idref="{escape(r["item_id"] or f"c{n}")}-{n}"/>')
            z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest>{"".join(items)}</manifest><spine>{"".join(refs)}</spine></package>')
        path = f"{folder}/{book}.epub"
        write_file(path, buffer.getvalue())
        return pd.DataFrame({"book_id": [book], "path": [path]})

    joined = chapters.join(books.select("book_id", F.col("title").alias("book_title")), "book_id")
    return joined.groupBy("book_id").applyInPandas(run, "book_id string, path string")  # a book is one file
