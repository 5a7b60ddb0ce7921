"""Column functions on text: cleaning, normalising, tokenising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it, as a Java pattern with (?U).
SPACE = r"[\s\x{1c}-\x{1f}]"
TOKEN = r"[a-zа-я0-9]+(?:\.[a-zа-я0-9]+)*"
EMPTY = "__empty__"
NBSP = " "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Spaces, tabs and no-break spaces as single spaces; stripped."""
    return strip(F.regexp_replace(F.translate(_col(c), NBSP, " "), r"[ \t]+", " "))


def clean(c: Column | str) -> Column:
    """collapse(), and at most one empty line in a row."""
    return strip(F.regexp_replace(F.regexp_replace(F.translate(_col(c), NBSP, " "), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def single_spaced(c: Column | str) -> Column:
    """Any white space as one space; stripped."""
    return strip(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))


def searchable(c: Column | str) -> Column:
    """Lower case, with one spelling of e and of the space."""
    return F.translate(F.lower(_col(c)), "ё" + NBSP, "е ")


def tokens(c: Column | str) -> Column:
    """Lexical tokens; a text without any has one sentinel, so it counts in lengths."""
    found = F.regexp_extract_all(searchable(c), F.lit(TOKEN), F.lit(0))
    # Bound through a one-element array, so the pattern runs once.
    return F.transform(F.array(found), lambda f: F.when(F.size(f) == 0, F.array(F.lit(EMPTY))).otherwise(f))[0]


def query_tokens(c: Column | str) -> Column:
    """Lexical tokens of a question, without the sentinel."""
    return F.regexp_extract_all(searchable(c), F.lit(TOKEN), F.lit(0))


def paragraphs(c: Column | str) -> Column:
    """Cleaned parts between blank lines that are not empty."""
    parts = F.split(clean(c), rf"(?U)\n{SPACE}*\n")
    return F.filter(F.transform(parts, clean), lambda p: p != "")


def is_table_title(c: Column | str) -> Column:
    return collapse(c).rlike(r"(?iu)^(?:Таблица|TABLE)(?U)\s+[A-Za-zА-Яа-я0-9.\-]+$")


def is_short_caption(c: Column | str, most: int = 300) -> Column:
    t = collapse(c)
    return (t != "") & ~t.contains("[TABLE_") & (F.length(t) <= most)


def preview(c: Column | str, size: int = 500) -> Column:
    """The first characters, on one line."""
    return F.translate(F.substring(_col(c), 1, size), "\n", " ")
