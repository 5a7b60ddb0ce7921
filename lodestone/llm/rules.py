"""Quality rules (operator 9): a threshold table compiled into one projection.

Every measure is a Spark expression over the whole text and every rule a row of
``RULES``; ``verdict`` turns the table into one boolean column. No user function runs.

Defined results: a null text counts as empty; an empty text fails the base rule; null
ids stay; equal rows are judged each; very long texts are judged whole; extra columns are
ignored, and stay in ``keep_good``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_SPACE

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this at from or are an have not he but they which you "
    "le la les de des du et un une en que qui dans pour pas sur au par est il elle "
    "der die das und in den von zu mit sich des auf nicht ein eine ist im dem "
    "el los las de y que en un una por con no se del al lo su para es como"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """numerator <= most * denominator (and >= least * denominator), once the denominator has reached `of`."""

    name: str
    numerator: str
    denominator: str
    most: float | None = None
    least: float | None = None
    of: int = 1


RULES = (
    Rule("symbols a word", "n_symbols", "n_words", most=0.1),
    Rule("long words", "word_chars", "n_words", most=25.0, least=1.0),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.3, of=4),
    Rule("shouted words", "n_shouted", "n_words", most=0.3, of=10),
    Rule("stop words", "n_stop", "n_words", least=0.02, of=30),
    Rule("same word again", "n_stutter", "n_words", most=0.2, of=10),
)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    fine = F.lit(True)
    for r in rules:
        x, y = F.col(r.numerator), F.col(r.denominator)
        for bound, ok in ((r.most, x <= F.lit(r.most) * y), (r.least, x >= F.lit(r.least) * y)):
            if bound is not None:
                fine = fine & ((y < r.of) | ok)
    return fine


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs) and the measures of its text: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_shouted, n_stop, n_stutter (all long)."""
    space = WORD_SPACE.replace("\\", "\\\\")
    df = docs.selectExpr("struct(*) as row", f"coalesce(`{text}`, '') as _t")
    df = df.withColumn("_w", F.expr(f"filter(split(_t, '{space}'), w -> w <> '')"))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    df = df.withColumn("_n", F.expr("size(_w)"))
    df = df.withColumn("_h", F.expr("if(_n < 5, cast(array() as array<bigint>), transform(sequence(0, greatest(_n - 5, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4))))"))
    # Sorted windows, only where some window occurs twice.
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, j) -> x.h = get(_s, j - 1).h or x.h = get(_s, j + 1).h), x -> x.i))"))
    symbols = "".join(SYMBOLS)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return df.select(
        "row",
        # Not known before it runs, so no filter on a measure is moved below it, where Spark would compute the lists again for every use.
        F.rand(0).alias("barrier"),
        F.expr("cast(_n as bigint)").alias("n_words"),
        F.expr(f"cast(length(regexp_replace(_t, '{space}', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(_t) - length(translate(_t, '{symbols}', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(_p, named_struct('n', 0L, 'last', -5), (a, i) -> named_struct('n', a.n + least(5, i - a.last), 'last', i), a -> a.n)").alias("n_repeat_words"),
        F.expr("cast(size(filter(_w, w -> length(w) > 1 and w = upper(w) and w <> lower(w))) as bigint)").alias("n_shouted"),
        F.expr(f"cast(size(filter(_w, w -> lower(w) in ({stops}))) as bigint)").alias("n_stop"),
        F.expr("cast(size(filter(_w, (w, i) -> w = get(_w, i - 1))) as bigint)").alias("n_stutter"),
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure(), base_failed (fewer than ten words, or over a fifth of the words in repeated 5-word windows) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")) | (F.col("barrier") < 0)
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, as they are."""
    return judge(docs, text, rules).filter("kept").select("row.*")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "n_stop", "n_stutter")


def rules_sql(rules: tuple[Rule, ...] = RULES, source: str = "documents") -> str:
    """DuckDB SQL for judge() over a table with doc_id and text, written from the definitions."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    word = r"[^\x20\x09-\x0D]+"
    tests = []
    for r in rules:
        if r.most is not None:
            tests.append(f"({r.denominator} < {r.of} or {r.numerator} <= {r.most} * {r.denominator})")
        if r.least is not None:
            tests.append(f"({r.denominator} < {r.of} or {r.numerator} >= {r.least} * {r.denominator})")
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from {source}),
w as (select r, doc_id, text, regexp_extract_all(text, '{word}') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
win as (select r, i, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w)),
twice as (select r, i from win qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct i + k) as n from twice, range(5) as o(k) group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
  cast(len(list_filter(w, lambda x: length(x) > 1 and x = upper(x) and x <> lower(x))) as bigint) as n_shouted,
  cast(len(list_filter(w, lambda x: lower(x) in ({stops}))) as bigint) as n_stop,
  cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_stutter
  from w left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not base_failed and {' and '.join(tests)} as kept from b"""
