"""Page layouts: text blocks outside tables, in reading order. Decoders of a page format give the rows."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean

#: What a page decoder gives: source_file, page_num, blocks and tables with their boxes.
BOX = "x0:double,y0:double,x1:double,y1:double,text:string"
PAGE = f"source_file string, page_num int, blocks array<struct<{BOX}>>, tables array<struct<{BOX}>>"


def meets(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def page_text(pages: DataFrame) -> DataFrame:
    """source_file, page_num, page_text (X3-X5): tables, and the blocks that touch none, by rounded (y, x); tables first among equals."""
    key = lambda e, kind, i: F.struct(F.round(e["y0"], 1).alias("y"), F.round(e["x0"], 1).alias("x"), F.lit(kind).alias("kind"), i.alias("i"), clean(e["text"]).alias("text"))
    tables = F.filter(F.transform("tables", lambda e, i: key(e, 0, i)), lambda e: e["text"] != "")
    free = F.filter("blocks", lambda b: ~F.exists("tables", lambda t: meets(b, t)))
    blocks = F.filter(F.transform(free, lambda e, i: key(e, 1, i)), lambda e: e["text"] != "")
    order = F.array_sort(F.concat(tables, blocks))
    shown = F.transform(order, lambda e: F.when(e["kind"] == 0, F.concat(F.lit("[TABLE_START]\n\n"), e["text"], F.lit("\n\n[TABLE_END]"))).otherwise(e["text"]))
    return pages.select("source_file", "page_num", F.array_join(shown, "\n\n").alias("page_text"))


def file_text(pages: DataFrame) -> DataFrame:
    """source_file, full_text: pages with their marks, in order. A file's pages are one text, as its reader needs."""
    marked = F.concat(F.lit("--- PAGE "), F.col("page_num"), F.lit(" ---\n\n"), F.col("page_text"))
    gathered = page_text(pages).select("source_file", F.struct("page_num", marked.alias("t")).alias("p")).groupBy("source_file").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return gathered.select("source_file", F.array_join(F.col("p.t"), "\n\n").alias("full_text"))


class _Text(HTMLParser):
    """Text and tables of a web page; scripts and styles are left out."""

    BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "section", "article", "header", "footer", "nav", "title", "body", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip, self.rows = 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            (self.rows or self.rows.append([]) or self.rows)[-1].append("")
        elif tag in self.BLOCKS:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            from lodestone.sources.docx import table_text

            self.parts.append("\n\n" + table_text(self.rows) + "\n\n")
            self.rows = None
        elif tag in self.BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.rows is None:
            self.parts.append(" ".join(data.split()) + (" " if data[-1:].isspace() else ""))
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1] += " ".join(data.split())


def html_text(html: str) -> str:
    from lodestone.sources.docx import tidy

    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return tidy("\n\n".join(p.strip() for p in "".join(parser.parts).split("\n\n") if p.strip()))


def html_column(html: str) -> Column:
    """The text of web pages."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_text)

    return run(F.col(html))
