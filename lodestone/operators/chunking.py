"""Text to pages, blocks and chunks.

Pages and paragraphs are column expressions. Blocks and chunks carry state from one
part to the next within a page, so they are Arrow functions on one page's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean
from lodestone.operators.numbering import numbered

SIZE, OVERLAP, TABLE_OVERLAP = 1200, 200, 4
# The marks of pages and tables in extracted text.
PAGE_MARK = r"--- PAGE (\d+) ---\n"
TABLE_START, TABLE_END = "[TABLE_START]", "[TABLE_END]"
_TITLE = re.compile(r"(?:Таблица|TABLE)\s+[A-Za-zА-Яа-я0-9.\-]+$", re.IGNORECASE)
_TABLE = re.compile(re.escape(TABLE_START) + ".*?" + re.escape(TABLE_END), re.DOTALL)
CHUNK = "struct<char_start:int,char_end:int,chunk_type:string,text:string>"


def tidy(text: str) -> str:
    """What functions.text.clean does to a column."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace(" ", " "))).strip()


def split_pages(files: DataFrame, text: str = "full_text") -> DataFrame:
    """files with page_ordinal, page_num, page_text (C2): the text after each page mark; without marks all is page 1.
    What stands before the first mark is left out, and so are empty pages."""
    t = F.col(text)
    numbers = F.transform(F.regexp_extract_all(t, F.lit(PAGE_MARK), F.lit(1)), lambda x: x.cast("int"))
    marked = F.arrays_zip(numbers.alias("num"), F.slice(F.split(t, PAGE_MARK), 2, 1 << 30).alias("text"))
    whole = F.array(F.struct(F.lit(1).alias("num"), t.alias("text")))
    pages = F.when(F.size(numbers) == 0, whole).otherwise(marked)
    out = files.select("*", F.posexplode(pages).alias("page_ordinal", "_p")).select(*files.columns, "page_ordinal", F.col("_p.num").alias("page_num"), clean(F.col("_p.text")).alias("page_text"))
    return out.filter("page_text <> ''")


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(type, text) of a page's paragraphs and tables (C6). A table's title, or title and short caption, goes with it."""
    out: list[tuple[str, str]] = []
    page = tidy(page)

    def prose(text: str) -> list[str]:
        return [p for p in map(tidy, re.split(r"\n\s*\n", tidy(text))) if p]

    at = 0
    for table in _TABLE.finditer(page):
        parts = prose(page[at : table.start()])
        flat = [re.sub(r"[ \t]+", " ", p).strip() for p in parts]
        heads = 0
        if len(flat) > 1 and _TITLE.match(flat[-2]) and TABLE_START[:7] not in flat[-1] and len(flat[-1]) <= 300:
            heads = 2
        elif flat and _TITLE.match(flat[-1]):
            heads = 1
        out += [("text", p) for p in parts[: len(parts) - heads]]
        out.append(("table", "\n\n".join([*parts[len(parts) - heads :], table.group().strip()])))
        at = table.end()
    return out + [("text", p) for p in prose(page[at:])]


def check(size: int, overlap: int) -> None:
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must be from 0 to half the chunk size")


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(start, end, stripped text) of sliding windows (C7). One that isn't the last ends before its last space, if that is in its second half."""
    text, start = tidy(text), 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", start, end)
            end = space if space > start + size // 2 else end
        end = min(end, len(text))
        if part := text[start:end].strip():
            yield start, end, part
        if end == len(text):
            return
        start = max(0, end - overlap)


def table_parts(text: str, size: int = SIZE, overlap: int = TABLE_OVERLAP) -> Iterator[str]:
    """A long table in parts of whole lines, its title before each; parts share lines and go on by one at least."""
    text = tidy(text)
    if len(text) <= size:
        yield text
        return
    lines = [x for x in text.splitlines() if x.strip()]
    head = next((i for i, x in enumerate(lines) if x.strip() == TABLE_START), len(lines))
    title, body = "\n".join(lines[:head]).strip(), lines[head:]
    room = max(size - len(title) - 2, 300)
    at = 0
    while at < len(body):
        to, used = at + 1, len(body[at]) + 1
        while to < len(body) and used + len(body[to]) + 1 <= room:
            used += len(body[to]) + 1
            to += 1
        yield ((title + "\n\n" if title else "") + "\n".join(body[at:to])).strip()
        if to == len(body):
            return
        at = max(at + 1, to - overlap)


def chunks_of(blocks: list[tuple[str, str]], size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of a page's blocks (C9): text blocks in a row are one text, each table is on its own."""
    out: list[dict] = []
    held: list[str] = []

    def flush() -> None:
        out.extend({"char_start": a, "char_end": b, "chunk_type": "text", "text": t} for a, b, t in windows("\n\n".join(held), size, overlap))
        held.clear()

    for kind, text in blocks:
        if kind == "text":
            held.append(text)
            continue
        flush()
        out.extend({"char_start": 0, "char_end": len(t), "chunk_type": "table", "text": t} for t in table_parts(text, size))
    flush()
    return out


def semantic_blocks(page):
    """A page's blocks as a column."""

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [{"type": k, "text": t} for k, t in blocks_of(p or "")])

    return run(page)


def page_chunks(size: int = SIZE, overlap: int = OVERLAP):
    """A function of a page's text that gives its chunks."""
    check(size, overlap)

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: chunks_of(blocks_of(p or ""), size, overlap))

    return run


def text_windows(size: int = SIZE, overlap: int = OVERLAP):
    """A function of a plain text that gives its windows, tables or not (C7 alone)."""
    check(size, overlap)

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": a, "char_end": b, "chunk_type": "text", "text": x} for a, b, x in windows(t or "", size, overlap)])

    return run


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """files: source_file, full_text -> chunks with ids of file stem, page and index on the page.
    Their order is (source_file, page_ordinal, chunk_index_on_page); file names are unique."""
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    pages = split_pages(files.select("source_file", "full_text"))
    each = pages.select("source_file", stem.alias("source_stem"), "page_ordinal", "page_num", F.posexplode(page_chunks(size, overlap)("page_text")).alias("_i", "_c"))
    index = F.col("_i") + 1
    return each.select(
        F.concat("source_stem", F.lit("_p"), "page_num", F.lit("_c"), index).alias("chunk_id"), "source_file", "source_stem", "page_ordinal", "page_num",
        index.alias("chunk_index_on_page"), "_c.char_start", "_c.char_end", "_c.chunk_type", "_c.text",
    )


def corpus_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_files with corpus_idx, each chunk's number in their order."""
    return numbered(chunk_files(files, size, overlap), "source_file", "page_ordinal", "chunk_index_on_page")
