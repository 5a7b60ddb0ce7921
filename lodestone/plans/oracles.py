"""DuckDB SQL with the results of the catalogue's queries, written from the definitions."""

from __future__ import annotations

from lodestone.functions.patterns import BIO_LABELS
from lodestone.operators.generate import SYSTEM, USER
from lodestone.plans import references

_SPACE = r"[ \t]+"
_STRIP = r"^[\s\x0b]+|[\s\x0b]+$"
_NB = "chr(160)"


def _clean(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(replace({c}, {_NB}, ' '), '{_SPACE}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '{_STRIP}', '', 'g')"


def _collapse(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace({c}, {_NB}, ' '), '{_SPACE}', ' ', 'g'), '{_STRIP}', '', 'g')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(translate(lower({c}), 'ё' || {_NB}, 'е '), '[a-zа-я0-9]+(?:\\.[a-zа-я0-9]+)*')"


_INDEX = f"""
toks as (select doc_id, case when len(t) = 0 then ['__empty__'] else t end as t from (select doc_id, {_tokens('text')} as t from documents)),
post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from toks) group by doc_id, term),
size as (select count(*) as n, avg(len(t)) as avgdl from toks),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from (select term, count(*) as df from post group by term), size),
terms as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"""


def _bm25(asked: str, k: int) -> str:
    """CTEs up to bm(question_id, doc_id, s, rank) for asked(question_id, question)."""
    return f"""{_INDEX},
asked as ({asked}),
q as (select question_id, term, count(*) as times from (select question_id, unnest({_tokens('question')}) as term from asked) group by question_id, term),
hit as (select question_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from q join terms using (term) join post using (term), size group by question_id, doc_id),
every as (select question_id, doc_id, coalesce(s, 0) as s from (select distinct question_id from q) cross join documents left join hit using (question_id, doc_id)),
bm as (select question_id, doc_id, s, row_number() over (partition by question_id order by round(s, 9) desc, doc_id) as rank from every qualify rank <= {k})"""


_ASKED = "select item_id as question_id, text as question from benchmark"


def _knn(k: int) -> str:
    """CTE nn(question_id, vec_id, s, rank)."""
    return f"""nn as (select question_id, vec_id, s, row_number() over (partition by question_id order by round(s, 9) desc, vec_id) as rank
from (select q.vec_id // 100 as question_id, v.vec_id, list_dot_product(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where q.vec_id % 100 = 0) qualify rank <= {k})"""


def _fused(most: int, lexical: bool = True) -> str:
    """CTE fused(question_id, chunk_id, dense_rank, bm25_rank, h, rank)."""
    side = "(select question_id, doc_id as chunk_id, rank as b from bm)" if lexical else "(select question_id, vec_id as chunk_id, rank as b from nn where false)"
    return f"""fused as (select question_id, chunk_id, d as dense_rank, b as bm25_rank, coalesce(1 / (60 + d), 0) + coalesce(1 / (60 + b), 0) as h,
row_number() over (partition by question_id order by round(coalesce(1 / (60 + d), 0) + coalesce(1 / (60 + b), 0), 12) desc, d nulls last, b nulls last, chunk_id) as rank
from (select question_id, vec_id as chunk_id, rank as d from nn) full join {side} using (question_id, chunk_id) qualify rank <= {most})"""


_EMAIL, _IP, _NUM = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", r"[0-9]{13,19}"
_LIC, _VER = r"Licen[sc]ed under [A-Za-z]+", r"Version [0-9]+[.][0-9]+"


def _all(p: str, flags: str = "") -> str:
    return f"regexp_extract_all(text, '{flags}{p}')"


_ENTS = f"list_sort(list_distinct(list_transform(list_concat({_all(_EMAIL)}, {_all(_IP)}, {_all(_NUM)}, {_all(_LIC)}, {_all(_VER)}), lambda x: lower(x))))"
_E = f"ents as (select doc_id, {_ENTS} as e from documents)"
_REFS = f"list_concat({_all(_EMAIL, '(?i)')}, {_all(_IP)}, {_all(_NUM)})"
_DOCS = f"list_concat({_all(_LIC, '(?i)')}, {_all(_VER, '(?i)')})"


def _form(x: str) -> str:
    """The index's normal form of a text without Cyrillic letters."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '([0-9])\\s*\\.\\s*([0-9])', '\\1.\\2', 'g'), '([0-9])\\s*\\.\\s*([0-9])', '\\1.\\2', 'g'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'))"


_INDEXED = f"""idx as (select doc_id, source, list_distinct(list_concat(
list_transform(list_filter(list_transform({_DOCS}, lambda x: {_form('x')}), lambda x: x <> ''), lambda x: ['NORM_DOC', x]),
list_transform(list_filter(list_transform(list_filter({_REFS}, lambda x: not regexp_matches(x, '^[0-9]+([.][0-9]+)*$')), lambda x: {_form('x')}), lambda x: regexp_matches(x, '[0-9]')), lambda x: ['NORM_REF', x]))) as e from documents),
idxs as (select doc_id, source, list_sort(e) as e from idx)"""


def _overlap(q: str, c: str) -> str:
    return f"case when len({q}) = 0 then 0 else len(list_intersect({q}, {c})) / len({q}) end"


def _reranked(source: str, base: str, weight: float, cand: str, k: int = 10, digits: int = 9) -> str:
    """CTE rr(question_id, chunk_id, ns, score, rank) over source(question_id, chunk_id, ...)."""
    return f"""rr as (select question_id, chunk_id, ns, {base} + {weight} * ns as score, row_number() over (partition by question_id order by round({base} + {weight} * ns, {digits}) desc, {cand}) as rank
from (select s.*, {_overlap("coalesce(q.e, []::varchar[])", "coalesce(c.e, []::varchar[])")} as ns from {source} s left join ents q on q.doc_id = s.question_id * 100 left join ents c on c.doc_id = s.chunk_id) qualify rank <= {k})"""


_NAMES = [m for k in (1, 3, 5, 10) for m in (f"hit@{k}", f"recall@{k}", f"precision@{k}")] + ["mrr@10", "ndcg@10"]


def _metrics(run: str, rel: str, asked: str, name: str = "m") -> str:
    """CTE name(question_id, metric, value) for run(question_id, chunk_id, rank), rel(question_id, chunk_id) and asked(question_id)."""
    parts = []
    for k in (1, 3, 5, 10):
        c = f"coalesce(count(r.rank) filter (where r.rank <= {k}), 0)"
        parts += [f"case when {c} > 0 then 1.0 else 0.0 end as \"hit@{k}\"", f"coalesce({c} / nullif(any_value(n), 0), 0) as \"recall@{k}\"", f"{c} / {k} as \"precision@{k}\""]
    parts.append("coalesce(1 / min(r.rank), 0) as \"mrr@10\"")
    parts.append("coalesce(sum(1 / log2(r.rank + 1)) / (list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1 / log2(i + 1)))), 0) as \"ndcg@10\"")
    cols = ", ".join(f'"{n}"' for n in _NAMES)
    return f"""{name}_w as (select a.question_id, {', '.join(parts)} from (select question_id, (select count(*) from {rel} x where x.question_id = {asked}.question_id) as n from {asked}) a
left join (select u.question_id, u.rank from {run} u join {rel} v using (question_id, chunk_id) where u.rank <= 10) r on r.question_id = a.question_id group by a.question_id),
{name} as (select question_id, metric, value from (select question_id, {', '.join(f'cast("{n}" as double) as "{n}"' for n in _NAMES)} from {name}_w) unpivot (value for metric in ({cols})))"""


_REL = "rel as (select item_id as question_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text))"
_LEX = f"with {_bm25(_ASKED, 10)}, {_REL}, run as (select question_id, doc_id as chunk_id, rank from bm), {_metrics('run', 'rel', 'asked')}"
_NREL = "nrel as (select q.vec_id // 100 as question_id, v.vec_id as chunk_id from embeddings q join embeddings v using (label) where q.vec_id % 100 = 0), nask as (select vec_id // 100 as question_id from embeddings where vec_id % 100 = 0)"
_TWO = f"""with {_knn(50)}, {_E}, cand as (select question_id, vec_id as chunk_id, rank as cr from nn), {_reranked('cand', '1 / s.cr', 0.5, 's.cr').replace('s.cr', 'cr')}, {_NREL},
run1 as (select question_id, vec_id as chunk_id, rank from nn where rank <= 10), {_metrics('run1', 'nrel', 'nask', 'm1')}, {_metrics('rr', 'nrel', 'nask', 'm2')},
g1 as (select metric, avg(value) as value from m1 group by metric), g2 as (select metric, avg(value) as value from m2 group by metric)"""

#: Matches of the catalogue's pack; none of them overlap, so their number is that of the kept spans.
_COUNTS = f"cnt as (select doc_id, source, text, len({_DOCS}) as nd, len({_REFS}) as nr, len({_all(_NUM)}) as nn from documents)"
_SCORED = f"{_COUNTS}, sc as (select doc_id, source, nd + nr as n, nn, 2 * (nd + nr) + 3 * nd + 2 * nr as auto_score from cnt where nd + nr > 0 and length(trim(text)) >= 80)"
_TURN = "select conv_id, turn, role, text, conv_id || '_' || turn as chunk_id from conversations"




def _pieces(p: str) -> str:
    """The matches of a pattern in text as a list of {t, a, b}: what stands between matches gives their places."""
    m, gaps = _all(p), f"list_transform(string_split_regex(text, '{p}'), lambda x: length(x))"
    before = f"(list_sum({gaps}[:i]) + coalesce(list_sum(list_transform({m}[:i - 1], lambda x: length(x))), 0))::int"
    return f"list_transform({m}, lambda x, i: {{'t': x, 'a': {before}, 'b': {before} + length(x)::int}})"


_PLACED = "placed as (select doc_id, label, p.t as text, p.a as start, p.b as \"end\" from (" + " union all ".join(
    f"select doc_id, '{label}' as label, unnest({_pieces(p)}) as p from documents" for label, p in (("NORM_REF", "(?i)" + _EMAIL), ("NORM_REF", _IP), ("NORM_REF", _NUM), ("NORM_DOC", "(?i)" + _LIC), ("NORM_DOC", "(?i)" + _VER))
) + "))"


def aligned(kept: str) -> str:
    """CTE aligned(doc_id, i, token, label) over placed and sc: words, single marks and the two tokens without width, with the labels of the kept spans."""
    return f"""own as (select * from placed where doc_id in (select doc_id from sc) and {kept}),
word as (select doc_id, {_pieces("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]")} as p from documents where doc_id in (select doc_id from sc)),
tok as (select doc_id, unnest(p).t as t, unnest(p).a as a, unnest(p).b as b, unnest(range(len(p))) as i from word),
met as (select t.doc_id, t.i, o.label, o.start, row_number() over (partition by t.doc_id, o.start, o.label order by t.i) as nth from tok t join own o on t.doc_id = o.doc_id and t.a < o.end and o.start < t.b),
named as (select doc_id, i, arg_max(case when nth = 1 then 'B-' else 'I-' end || label, start) as name from met group by doc_id, i),
ids as (select * from (values {", ".join(f"({i}, '{n}')" for i, n in enumerate(BIO_LABELS))}) v(label, name)),
aligned as (select doc_id, (i + 1)::int as i, t as token, coalesce(ids.label, 0)::int as label from tok left join named using (doc_id, i) left join ids using (name)
union all select doc_id, 0, '[CLS]', -100 from word union all select doc_id, len(p)::int + 1, '[SEP]', -100 from word)"""


_SPLIT = "split as (select doc_id::varchar as id, case when rn <= greatest(1, floor(n * 0.2)) then 'dev' else 'train' end as split from (select doc_id, row_number() over (order by md5(doc_id || ':42') || ':' || doc_id) as rn, count(*) over () as n from sc))"

#: Lines with bars as a titled table after the others.
_BLOCKS = f"""rows_ as (select doc_id, string_split(text, chr(10)) as ls from documents),
parted as (select doc_id, list_filter(list_transform(list_filter(ls, lambda x: not contains(x, ' | ')), lambda x: {_clean('x')}), lambda x: x <> '') as prose, list_filter(ls, lambda x: contains(x, ' | ')) as rows from rows_),
blocks as (select doc_id, list_concat(list_transform(prose, lambda x: {{'type': 'text', 'text': x}}), case when len(rows) > 0 then [{{'type': 'table', 'text': 'TABLE 1' || chr(10) || chr(10) || {_clean("'[TABLE_START]' || chr(10) || replace(array_to_string(rows, chr(10)), ' | ', chr(10)) || chr(10) || '[TABLE_END]'")}}}] else [] end) as b from parted)"""


def oracle_sql() -> dict[str, str]:
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[^\\s]+'))"
    out = {
        "text_clean": f"select doc_id, {_clean('text')} as cleaned, {_collapse('text')} as collapsed from documents",
        "tokenize": f"with {_INDEX.strip()} select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from toks",
        "bm25_index_stats": f"with {_INDEX.strip()} select term, df, round(idf, 6) as idf from terms",
        "bm25_topk": f"with {_bm25(_ASKED, 10).strip()} select question_id, doc_id, round(s, 6) as score, rank from bm",
        "knn_topk": f"with {_knn(10)} select question_id, vec_id, round(s, 6) as score, rank from nn",
        "rrf_hybrid": f"with {_bm25(_ASKED, 100).strip()}, {_knn(100)}, {_fused(100)} select question_id, chunk_id, coalesce(dense_rank, 0) as dense_rank, coalesce(bm25_rank, 0) as bm25_rank, round(h, 9) as hybrid_score, rank from fused",
        "hybrid_single_side": f"with {_knn(100)}, {_fused(10, False)} select question_id, chunk_id, round(h, 9) as hybrid_score, rank from fused",
        "entity_extract": f"with {_E} select doc_id, array_to_string(e, '|') as entities from ents where len(e) > 0",
        "entity_normalize": f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'ё' || {_NB}, 'е '), '([0-9])\\s*\\.\\s*([0-9])', '\\1.\\2', 'g'), '([0-9])\\s*\\.\\s*([0-9])', '\\1.\\2', 'g'), '\\s*[-–—]\\s*', '-', 'g'), '\\s+', ' ', 'g')) as normal from documents",
        "entity_clean": f"with {_INDEXED} select doc_id, array_to_string(list_transform(e, lambda x: x[1] || ':' || x[2]), '|') as entities from idxs",
        "entity_index": f"with {_INDEXED} select doc_id, source as source_file, 1 as page_num, array_to_string(list_transform(e, lambda x: x[1]), '|') as labels, array_to_string(list_transform(e, lambda x: x[2]), '|') as texts from idxs",
        "entity_overlap_score": f"with {_E} select a.doc_id, array_to_string(list_sort(list_intersect(a.e, b.e)), '|') as overlap, round({_overlap('a.e', 'b.e')}, 6) as score from ents a join ents b on b.doc_id = a.doc_id + 1",
        "knn_entity_rerank": f"with {_knn(50)}, {_E}, cand as (select question_id, vec_id as chunk_id, rank as cr from nn), {_reranked('cand', '1 / cr', 0.5, 'cr')} select question_id, chunk_id, round(ns, 6) as ner_score, round(score, 6) as score, rank from rr",
        "hybrid_entity_rerank": f"with {_bm25(_ASKED, 100).strip()}, {_knn(100)}, {_fused(100)}, {_E}, cand as (select question_id, chunk_id, h, rank as cr from fused), {_reranked('cand', 'h', 0.05, 'cr')} select question_id, chunk_id, round(ns, 6) as ner_score, round(score, 9) as score, rank from rr",
        "metrics_per_question": f"{_LEX} select question_id, metric, round(value, 6) as value from m",
        "metrics_mean": f"{_LEX} select metric, round(avg(value), 6) as value from m group by metric",
        "metrics_delta": f"{_TWO} select metric, round(coalesce(g2.value, 0) - coalesce(g1.value, 0), 6) as value from g1 full join g2 using (metric)",
        "metrics_wide": f"{_TWO} select p as pipeline, "
        + ", ".join(f"round(max(value) filter (where metric = '{n}'), 6) as \"{n.replace('@', '_at_')}\"" for n in _NAMES)
        + " from (select 'dense' as p, * from g1 union all select 'dense_entities' as p, * from g2) group by p",
        "run_records": f"with {_bm25(_ASKED, 10).strip()} select question_id, 'bm25' as pipeline, string_agg(rank || ':' || doc_id, '|' order by rank) as ranked from bm group by question_id",
        "run_items": f"""with {_bm25(_ASKED, 100).strip()}, {_knn(100)}, {_fused(100)}, {_E}, cand as (select question_id, chunk_id, h, rank as cr from fused), {_reranked('cand', 'h', 0.05, 'cr')},
both_ as (select question_id, 'hybrid' as pipeline, rank, chunk_id, h as score, dense_rank, bm25_rank, h as hybrid_score, -1 as total, -1 as ns, [] as o, []::varchar[] as q from fused where rank <= 10
union all select r.question_id, 'hybrid_entities', r.rank, r.chunk_id, r.score, f.dense_rank, f.bm25_rank, f.h, r.score, r.ns, list_sort(list_intersect(coalesce(q.e, []), coalesce(c.e, []))), coalesce(q.e, [])
from rr r join fused f using (question_id, chunk_id) left join ents q on q.doc_id = r.question_id * 100 left join ents c on c.doc_id = r.chunk_id)
select question_id, md5(b.text) as question_md5, pipeline, rank::int as rank, chunk_id::varchar as chunk_id, coalesce(d.source, '') as source_file, case when d.doc_id is null then -1 else 1 end as page_num, case when d.doc_id is null then '' else 'text' end as chunk_type,
round(score, 9) as score, coalesce(dense_rank, -1)::int as dense_rank, coalesce(bm25_rank, -1)::int as bm25_rank, round(hybrid_score, 9) as hybrid_score, round(total, 9) as ner_score_total, rank::int as final_rank, round(ns, 9) as ner_score, array_to_string(o, '|') as ner_overlap, array_to_string(q, '|') as query_entities
from both_ join benchmark b on b.item_id = question_id left join documents d on d.doc_id = chunk_id""",
        "chunk_text": f"""with recursive t as (select doc_id, {_clean('text')} as text from documents),
w as (select doc_id, text, 0 as i, 0 as s, cut(text, 0) as e from t where text <> ''
union all select doc_id, text, i + 1, greatest(0, e - 200), cut(text, greatest(0, e - 200)) from w where e < length(text))
select doc_id, row_number() over (partition by doc_id order by i) - 1 as i, s as char_start, e as char_end, x as text from (select *, regexp_replace(substr(text, s + 1, e - s), '{_STRIP}', '', 'g') as x from w) where x <> ''""",
        "page_split": f"select conv_id || '.txt' as source_file, turn as page_num, {_clean('text')} as page_text from conversations where {_clean('text')} <> ''",
        "paragraph_split": f"""with p as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)), lambda x: {_clean('x')}), lambda x: x <> '') as p from documents)
select doc_id, unnest(range(len(p))) as i, unnest(p) as paragraph from p""",
        "annotate_score": f"with {_SCORED} select doc_id, n, auto_score from sc",
        "annotate_topk": f"with {_SCORED} select doc_id::varchar as chunk_id, source as source_file, auto_score from sc order by auto_score desc, source, doc_id::varchar limit 1000",
        "export_incremental": f"""with {_SCORED}, known as (select * from sc where doc_id in (select doc_id from labels)), new as (select * from sc where doc_id not in (select doc_id from known) order by auto_score desc, source, doc_id::varchar limit 1000)
select doc_id::varchar as chunk_id, auto_score, 0 as src from known union all select doc_id::varchar, auto_score, 1 from new""",
        "annotate_counters": f"""with {_COUNTS} select count(*) as scanned, count(*) filter (where doc_id in (select doc_id from labels)) as existing,
count(*) filter (where doc_id not in (select doc_id from labels) and length(trim(text)) < 80) as short,
count(*) filter (where doc_id not in (select doc_id from labels) and length(trim(text)) >= 80 and nd + nr > 0) as with_entities from cnt""",
        "finalize_entities": f"with {_SCORED} select doc_id, n - nn as n_left, nn as removed from sc",
        "label_vocabulary": f"with {_PLACED}, {_SCORED}, {aligned('true')} select ids.label as label_id, name as label, count(a.doc_id) as n from ids left join aligned a on a.label = ids.label group by all",
        "span_scores": f"with {_COUNTS} select 1.0::double as precision, round(sum(nd) / sum(nd + nr), 6) as recall, round(2 * sum(nd) / (sum(nd) + sum(nd + nr)), 6) as f1 from cnt",
        "format_context": f"""select conv_id, chr(10) || chr(10) || string_agg('[SOURCE ' || turn || ']' || chr(10) || 'file: ' || role || chr(10) || 'page: ' || turn || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'text:' || chr(10) || text,
chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) order by turn) as context from ({_TURN}) group by conv_id""",
        "source_list": f"select conv_id, string_agg(role || ',' || turn || ',' || chunk_id, '|' order by turn) as sources from ({_TURN}) group by conv_id",
        "hit_preview": "select doc_id, replace(substr(text, 1, 500), chr(10), ' ') as preview from documents",
        "select_records": "select doc_id::varchar as chunk_id, source as source_file from documents where contains(lower(source), 'src1') and contains(lower(text), 'licensed')",
        "pair_rerank": f"""with {_bm25(_ASKED, 10).strip()}, w as (select question_id, doc_id, rank as cr, {words('b.text')} as q, {words('d.text')} as t from bm join benchmark b on b.item_id = question_id join documents d using (doc_id)),
l as (select question_id, doc_id, cr, 1 / (1 + exp(-(len(list_intersect(q, t)) - 0.5 * (len(q) - len(list_intersect(q, t)))))) as s from w)
select question_id, doc_id, round(s, 6) as score, row_number() over (partition by question_id order by round(s, 9) desc, cr) as rank from l qualify rank <= 5""",
        "train_dev_split": f"with {_SCORED}, {_SPLIT} select id, split from split",
        "semantic_blocks": f"""with {_BLOCKS} select doc_id, unnest(range(len(b)::int))::int as i, unnest(b).type as type, unnest(b).text as text from blocks""",
        "chunk_ids": f"""with recursive t as (select conv_id, turn, {_clean('text')} as text from conversations),
w as (select conv_id, turn, text, 0 as i, 0 as s, cut(text, 0) as e from t where text <> ''
union all select conv_id, turn, text, i + 1, greatest(0, e - 200), cut(text, greatest(0, e - 200)) from w where e < length(text)),
x as (select *, regexp_replace(substr(text, s + 1, e - s), '{_STRIP}', '', 'g') as x from w),
n as (select *, row_number() over (partition by conv_id, turn order by i)::int as c from x where x <> '')
select row_number() over (order by conv_id || '.txt', turn, c) - 1 as corpus_idx, conv_id || '_p' || turn || '_c' || c as chunk_id, conv_id || '.txt' as source_file, conv_id::varchar as source_stem, turn::int as page_num, c as chunk_index_on_page, s as char_start, e as char_end, 'text' as chunk_type, x as text from n""",
        "annotate_spans": f"with {_PLACED} select doc_id, label, text, start, \"end\" from placed",
        "bio_align": f"with {_PLACED}, {_SCORED}, {aligned('true')} select doc_id, i, label from aligned",
        "pair_hybrid": f"""with {_bm25(_ASKED, 20).strip()}, {_knn(20)}, {_fused(20)}, w as (select question_id, chunk_id, rank as cr, {words('b.text')} as q, {words('d.text')} as t from fused join benchmark b on b.item_id = question_id join documents d on d.doc_id = chunk_id),
l as (select question_id, chunk_id, cr, 1 / (1 + exp(-(len(list_intersect(q, t)) - 0.5 * (len(q) - len(list_intersect(q, t)))))) as s from w)
select question_id, chunk_id, round(s, 6) as score, row_number() over (partition by question_id order by round(s, 9) desc, cr) as rank from l qualify rank <= 6""",
        "answers": f"""with c as (select conv_id, string_agg('[SOURCE ' || turn || ']' || chr(10) || 'file: ' || role || chr(10) || 'page: ' || turn || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'text:' || chr(10) || text, chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) order by turn) as context from ({_TURN}) group by conv_id)
select conv_id, 'T=0.1 N=600 ' || {len(SYSTEM)} || ' ' || ({len(USER)} - length('{{context}}{{question}}') + length(context) + 2 + length('Question ' || conv_id)) as answer from c""",
        "jsonl_round_trip": "select doc_id, md5(coalesce(text, '')) as text_md5, lang, source, n_chars from documents",
        "jsonl_traced": "select doc_id, n_chars, doc_id % 4 as part, row_number() over (partition by doc_id % 4 order by doc_id) as line, true as raw from documents",
        "json_arrays": "select item_id, text from benchmark",
        "pretty_summary": "select count(*) as documents, count(distinct source) as sources from documents",
        "text_folders": "select md5(x) as text_md5, length(x) as n_chars from (select string_agg(coalesce(text, ''), chr(10) order by turn) || chr(10) as x from conversations group by conv_id)",
        "text_table": "select doc_id || '.txt' as source_file, 'in/' || doc_id || '.DOCX' as path, length(text) as n_chars from documents where doc_id % 7 <> 0 and length(text) > 0",
        "discovered_files": "select unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' as name",
        "docx_extract": f"""with c as (select conv_id::varchar as id, string_agg(t, chr(10) || chr(10) order by turn) filter (where t <> '') as body, string_agg('|' || turn || '|' || role || '|', chr(10) order by turn) as rows, string_agg(role, chr(10) || chr(10) order by turn) as roles
from (select *, {_clean('text')} as t from conversations) group by conv_id)
select id || '.docx' as path, case when id not like '%7' then concat_ws(chr(10) || chr(10), body, '[TABLE_START]', '|turn|role|' || chr(10) || '|---|---|' || chr(10) || rows, '[TABLE_END]', 'role' || chr(10) || chr(10) || roles) end as text,
case when id like '%7' then 'BadZipFile' end as error from c""",
        "layout_pages": f"""with b as (select conv_id, 10 * turn as y, {_clean('text')} as t from conversations where not (10 * turn < 29 and 19 < 10 * turn + 8) union all select distinct conv_id, 19, concat_ws(chr(10) || chr(10), '[TABLE_START]', '|a|b|', '[TABLE_END]') from conversations)
select conv_id::varchar as source_file, '--- PAGE 1 ---' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by y) as full_text from b where t <> '' group by conv_id""",
        "appended_rows": "select doc_id, quality from labels",
    }
    out |= {"metrics_csv": out["metrics_wide"], "index_round_trip": out["bm25_topk"], "vectors_round_trip": out["knn_topk"], "split_files": out["train_dev_split"]}
    # The window's end as plain SQL: the last space in its second half, unless the text ends first.
    part = lambda s: f"substr(text, {s} + 1, 1200)"
    for s in ("greatest(0, e - 200)", "0"):
        back = f"strpos(reverse({part(s)}), ' ')"
        end = f"cast(case when {s} + 1200 >= length(text) then length(text) when {back} > 0 and 1200 - {back} > 600 then {s} + 1200 - {back} else {s} + 1200 end as int)"
        out |= {name: out[name].replace(f"cut(text, {s})", end) for name in ("chunk_text", "chunk_ids")}
    return out | references.oracle_sql(_tokens, lambda asked, k: _bm25(asked, k).strip())


def job_sql() -> dict[str, str]:
    """What the jobs' output is over documents."""
    return {
        "job1_refresh_index": f"with {_INDEX.strip()} select term, doc_id, tf, dl, df from post join terms using (term)",
        # Spans that are a number only are no references.
        "job2_tagger_corpus": f"with {_PLACED}, {_SCORED}, {aligned('not regexp_full_match(text, $$[0-9]+$$)')}, {_SPLIT} select id, split, i, token, label from aligned join split on split.id = aligned.doc_id::varchar",
    }
