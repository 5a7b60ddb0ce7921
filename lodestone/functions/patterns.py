"""Pattern packs: names and regular expressions of entities, and word lists."""

from __future__ import annotations

# Entities of questions about Russian technical rules.
QUERY_ENTITIES = [
    r"\bСП\s+\d+(?:\.\d+)*(?:-\d+)?\b",
    r"\bНП[-\s]?\d+[-–—]\d+\b",
    r"\bСТО\s+\d+\s+\d+[-–—]\d+\b",
    r"\bПУЭ\b",
    r"\bглав[аеуы]\s+\d+(?:\.\d+)*\b",
    r"\bраздел[ае]?\s+\d+(?:\.\d+)*\b",
    r"\bп\.\s*\d+(?:\.\d+)*\b",
    r"\bпункт[ае]?\s+\d+(?:\.\d+)*\b",
    r"\bтабл\.\s*[А-ЯA-Z]?\d+(?:\.\d+)*\b",
    r"\bтаблиц[аеуы]\s+[А-ЯA-Z]?\d+(?:\.\d+)*\b",
]

# Entities of annotated texts, by label.
ANNOTATIONS = {
    "NORM_DOC": [
        r"\bГОСТ(?:\s+Р)?(?:\s+IEC)?\s+\d[\d\.\-–—]*\b",
        r"\bГОСТ\s+[A-ZА-ЯЁ]+\s+\d[\d\.\-–—]*\b",
        r"\bСП\s+\d[\d\.\-–—]*\b",
        r"\bСНиП\s+\d[\d\.\-–—]*\b",
        r"\bНП-\d+-\d+\b",
        r"\bРТМ\s+\d[\d\.\-–—]*\b",
        r"\bПУЭ\b",
    ],
    "NORM_REF": [
        r"\bп\.\s*\d+(?:\.\d+)*\b",
        r"\bпп\.\s*\d+(?:\.\d+)*(?:\s*,\s*\d+(?:\.\d+)*)*\b",
        r"\bгл\.\s*\d+(?:\.\d+)*\b",
        r"\bглава\s+\d+(?:\.\d+)*\b",
        r"\bраздел\s+\d+(?:\.\d+)*\b",
        r"\bтабл\.\s*\d+(?:\.\d+)*\b",
        r"\bтаблица\s+\d+(?:\.\d+)*\b",
        r"\bприложение\s+[А-ЯA-Z0-9IVXLC]+\b",
    ],
    "DATE": [
        r"\b\d{2}\.\d{2}\.\d{4}\b",
        r"\b\d{1,2}\s+[А-Яа-яЁё]+\s+\d{4}\s*г\.?\b",
    ],
}

# How inflected and short forms of references are folded, in this order.
FOLDS_QUERY = [
    (r"\bтабл\.\s*", "таблица "),
    (r"\bтаблиц[аеуы]\s+", "таблица "),
    (r"\bрис\.\s*", "рисунок "),
    (r"\bпп\.\s*", "пп. "),
    (r"\bпункт[ае]?\s+", "п. "),
    (r"\bп\.\s*", "п. "),
    (r"\bглав[аеуы]\s+", "глава "),
    (r"\bраздел[ае]?\s+", "раздел "),
    (r"(?<=\d)\s*\.\s*(?=\d)", "."),
    (r"\s*[-–—]\s*", "-"),
]
FOLDS_INDEX = [
    (r"\bтабл\.\s*", "таблица "),
    (r"\bрис\.\s*", "рисунок "),
    (r"\bпп\.\s*", "пп. "),
    (r"\bп\.\s*", "п. "),
    (r"(?<=\d)\s*\.\s*(?=\d)", "."),
    (r"\s*-\s*", "-"),
]

# Texts that are no entity, by label ("" for any).
NOT_PREDICTED = {
    "": [r"^#+", r"^[\.\,\-\–—\:\;\(\)\[\]\s]+$"],
    "NORM_REF": [r"^\d+$", r"^\d+(?:\.\d+)*$"],
    "NORM_DOC": [r"^\d+$", r"^пуэ\s*[\.\-–—]?\s*\d+$"],
}
NOT_ANNOTATED = {
    "": [r"^#+", r"^\d+$", r"^[\.\,\-\–—\:\;\(\)\[\]\s]+$"],
    "NORM_REF": [r"^приложение\s+\d+$"],
}

# References that say nothing alone, and beginnings that do.
GENERIC_REFERENCES = ["приложение", "приложение к", "форма", "рисунок", "таблица", "глава", "раздел", "пункт"]
TELLING_BEGINNINGS = ["глава ", "раздел ", "таблица ", "рисунок ", "п. ", "пп. "]
INDEXED_LABELS = ["NORM_DOC", "NORM_REF"]

# Labels of the token classifier.
ENTITY_LABELS = ["ORG", "DATE", "ADDRESS", "NORM_DOC", "NORM_REF"]
BIO_LABELS = ["O"] + [f"{p}-{x}" for x in ENTITY_LABELS for p in "BI"]

#: Entities that occur in general web text.
GENERAL = {
    "EMAIL": [r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]"],
    "ADDRESS": [r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"],
    "NUMBER": [r"[0-9]{13,19}"],
    "LICENCE": [r"Licen[sc]ed under [A-Za-z]+", r"Version [0-9]+[.][0-9]+"],
}


def java(pattern: str) -> str:
    """A pattern that ignores case and knows all scripts and spaces."""
    return "(?iuU)" + pattern
