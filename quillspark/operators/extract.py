"""Titles and paragraphs of marked-up chapters.

A Python worker only turns markup into text nodes in document order; which of them are the title and the
paragraphs, and in what order, is decided by Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import normalize_whitespace
from ..functions.titles import choose_title, strip

WANTED = ("h1", "h2", "p", "li")
# Fixed values of the HTML standard: tags whose start ends an open paragraph, tags without an end, tags of raw text.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt search summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
_NODE = StructType([StructField("tag", StringType()), StructField("text", StringType())])
NODES = StructType([StructField("title", StringType()), StructField("nodes", ArrayType(_NODE)), StructField("body", StringType())])


class _Collector(HTMLParser):
    """Text of the wanted elements, the first title and the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.title: list[str] | None = None
        self.body: list[str] = []
        self.head = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self._close_p()
            return
        if tag == "head":
            self.head = True
        elif tag == "body" or (tag not in ("html", "title", "meta", "link", "base", "style", "script", "noscript", "template") and self.head):
            self.head = False
        if tag in ENDS_P:
            self._close_p()
        if tag == "li":
            self._close("li", stop=("ul", "ol", "menu"))
        elif tag in ("h1", "h2") and self.open and self.open[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        text: list[str] | None = None
        if tag in WANTED:
            text = []
            self.nodes.append((tag, text))
        elif tag == "title" and self.title is None:
            text = self.title = []
        self.open.append((tag, text))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        if tag == "p" and not any(t == "p" for t, _ in self.open):
            self.nodes.append(("p", []))
            return
        self._close(tag)

    def _close_p(self) -> None:
        self._close("p", stop=("button", "table", "td", "th", "caption", "object", "html"))

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_data(self, data: str) -> None:
        inside = [t for _, t in self.open if t is not None]
        for text in inside:
            text.append(data)
        if not self.head and not any(t == "title" for t, _ in self.open):
            self.body.append(data)


def parse(html: str | None) -> dict:
    """Text nodes of one document; text in two wanted elements is in both."""
    c = _Collector()
    c.feed(html or "")
    c.close()
    return {"title": "".join(c.title or ()), "nodes": [{"tag": t, "text": "".join(x)} for t, x in c.nodes], "body": "".join(c.body)}


@F.pandas_udf(NODES)
def text_nodes(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in html:
        yield pd.DataFrame([parse(h) for h in batch], columns=["title", "nodes", "body"])


def _of(nodes: Column, tag: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"] == tag)


def extract_chapters(df: DataFrame, html: str = "html", item_id: str | None = None, order: str = "tag") -> DataFrame:
    """``df`` without ``html`` but with title and paragraphs.

    The title is <title>, else the first h1, else (if that is blank) the first h2; placeholders give way to the
    item's id and the start of the text. Paragraphs are those of h1, then h2, p and li, or with
    ``order='document'`` as they stand; blank ones and repetitions of the heading are left out, and where nothing
    is left the whole body is one. Null markup is an empty chapter.
    """
    x = df.withColumn("_x", text_nodes(F.coalesce(html, F.lit(""))))
    nodes = F.col("_x.nodes")
    heads = [strip(F.coalesce(F.get(_of(nodes, tag), 0)["text"], F.lit(""))) for tag in ("h1", "h2")]
    x = x.withColumn("_heading", F.when(heads[0] != "", heads[0]).otherwise(heads[1]))
    ranked = nodes if order == "document" else F.concat(*(_of(nodes, tag) for tag in WANTED))
    texts = F.transform(ranked, lambda n: F.struct(n["tag"].alias("tag"), normalize_whitespace(n["text"]).alias("text")))
    kept = F.filter(texts, lambda n: (n["text"] != "") & ~(n["tag"].isin("h1", "h2") & (F.col("_heading") != "") & (n["text"] == F.col("_heading"))))
    body = normalize_whitespace(F.col("_x.body"))
    x = x.withColumn("paragraphs", F.transform(kept, lambda n: n["text"]))
    x = x.withColumn("paragraphs", F.when(F.size("paragraphs") > 0, F.col("paragraphs")).when(body != "", F.array(body)).otherwise(F.array().cast("array<string>")))
    title = strip(F.col("_x.title"))
    x = x.withColumn("extracted_title", F.when(title != "", title).otherwise(F.col("_heading")))
    chosen = choose_title(F.col("extracted_title"), F.col(item_id) if item_id else F.lit(None).cast("string"), F.col("paragraphs"))
    return x.withColumn("title", chosen).drop("_x", "_heading", html)
