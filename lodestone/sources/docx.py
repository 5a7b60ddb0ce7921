"""DOCX text with the standard library: paragraphs and tables in body order.

A table whose rows have one filled cell at most is layout and gives plain text.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace(" ", " "))).strip()


def _runs(p: ET.Element) -> str:
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
    return "".join(marks[e.tag](e) for e in p.iter() if e.tag in marks)


def _gap(row: ET.Element, name: str) -> int:
    found = row.find(f"{_W}trPr/{_W}{name}")
    return int(found.get(f"{_W}val", "0")) if found is not None else 0


def cells(row: ET.Element) -> list[str]:
    """A row's cell texts with its gaps at both ends; a cell over several columns is repeated."""
    out = [""] * _gap(row, "gridBefore")
    for cell in row.findall(f"{_W}tc"):
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        out += [tidy("\n".join(_runs(p) for p in cell.findall(f"{_W}p")))] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
    return out + [""] * _gap(row, "gridAfter")


def square(rows: list[list[str]]) -> list[list[str]]:
    """Rows with text, filled up to one width."""
    held = [r for r in rows if any(c.strip() for c in r)]
    width = max(map(len, held), default=0)
    return [r + [""] * (width - len(r)) for r in held]


def is_layout(rows: list[list[str]]) -> bool:
    """No row has more than one filled cell."""
    return all(sum(bool(c.strip()) for c in r) <= 1 for r in rows)


def plain(rows: list[list[str]]) -> str:
    return "\n\n".join("\n".join(c.strip() for c in r if c.strip()) for r in rows if any(c.strip() for c in r)).strip()


def markdown(rows: list[list[str]]) -> str:
    """The first row as header (X11); bars in cells are left as they are."""
    if not rows:
        return ""
    line = lambda r: "|" + "|".join(r) + "|"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]).strip()


def table_text(rows: list[list[str]]) -> str:
    """Marked markdown of a table, plain text of a layout, nothing for an empty one."""
    rows = square(rows)
    if is_layout(rows):
        return plain(rows)
    return "\n\n".join(["[TABLE_START]", markdown(rows), "[TABLE_END]"])


def docx_text(content: bytes) -> str:
    """An Extractor."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    parts = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            parts.append(tidy(_runs(e)))
        elif e.tag == f"{_W}tbl":
            parts.append(table_text([cells(r) for r in e.findall(f"{_W}tr")]))
    return "\n\n".join(p for p in parts if p).strip()
