"""SQL that gives the same rows as the registered queries, for an engine with RE2 patterns and list functions."""

from __future__ import annotations

from foliant.functions.text import COVERAGE, EVIDENCE_STOP_WORDS, STOP_WORDS, SUFFIXES
from foliant.operators.calculation import MOST_OPERANDS, UNITS, VOCABULARY
from foliant.plans import routing

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNKS = "(select distinct id, document_id, page_number, content, section, start_offset, end_offset from chunks)"
PAGES = "(select distinct id, document_id, page_number, content, status, source_type from page_text)"
PAGES_BLOCKS = "(select distinct id, content, blocks from page_text)"
FILES = "(select distinct id, filename, page_count, status, content_hash, source, created_at from pdf_documents)"
IMAGES = "(select distinct id, document_id, page_number, bbox, xref from document_images)"
MESSAGES = "(select distinct id, conversation_id, role, content, reply_to_message_id, created_at from messages)"


def words(names: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in names) + ")"


def bounded(pattern: str) -> str:
    """A pattern whose word boundaries are those of all scripts: \\b as the edge of the text or a character that is no word's."""
    return "(?i)" + pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])").replace("'", "''")




def span_query(table: str, key: str, text: str, collapse: bool = True) -> str:
    cut = lambda a: f"(case when least(length(s), {a} + 900) < length(s) and strpos(reverse(substr(s, {a} + 1, 900)), ' .') > 0 and {a} + 900 - strpos(reverse(substr(s, {a} + 1, 900)), ' .') - 1 > {a} + 300 then {a} + 900 - strpos(reverse(substr(s, {a} + 1, 900)), ' .') else least(length(s), {a} + 900) end)"
    return rf"""
with recursive t as (select {key}, {f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))" if collapse else text} as s from {table}),
w as (
  select {key}, s, 0 as chunk_index, 0 as a, {cut("0")} as b from t where s is not null and s != ''
  union all
  select {key}, s, chunk_index + 1, greatest(b - 150, a + 1), {cut("greatest(b - 150, a + 1)")} from w where b < length(s))
select {key}, cast(chunk_index as integer) as chunk_index, cast(a as integer) as start_offset, cast(b as integer) as end_offset from w
"""


ASKED = f"""
asked as (
  select question_id, term, row_number() over (partition by question_id order by place) as place, count(*) over (partition by question_id) as n_terms from (
    select cast(item_id as bigint) as question_id, term, min(place) as place from (
      select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) as place from eval_items)
    where length(term) > 2 and term not in {words(STOP_WORDS)} group by item_id, term))"""

BM25_ALL = rf"""
{ASKED},
c as {CHUNKS},
tok as (select id, regexp_extract_all(regexp_replace(strip_accents(lower(content)), '\p{{Mn}}', '', 'g'), '[\p{{L}}\p{{N}}]+') as t from c),
stats as (select count(*) as n, avg(coalesce(len(t), 0)) as avg_len from tok),
post as (select term, id, count(*) as tf, dl from (select id, len(t) as dl, unnest(t) as term from tok) where term in (select term from asked) group by term, id, dl),
df as (select term, count(*) as df from post group by term),
items as (select a.question_id, p.id, p.dl, p.tf, df.df, a.n_terms from asked a join post p on p.term = a.term join df on df.term = a.term),
phrases as (select question_id, ' ' || string_agg(term, '  ' order by place) || ' ' as phrase, n_terms from asked where n_terms >= 2 group by question_id, n_terms),
whole as (select question_id, id, dl from items where n_terms >= 2 group by question_id, id, dl, n_terms having count(*) = n_terms),
spelled as (select id, ' ' || array_to_string(t, '  ') || ' ' as s from tok),
hits as (
  select w.question_id, w.id, w.dl, (length(s.s) - length(replace(s.s, p.phrase, ''))) // length(p.phrase) as tf
  from whole w join phrases p on p.question_id = w.question_id join spelled s on s.id = w.id),
pdf as (select question_id, count(*) as df from hits where tf > 0 group by question_id),
every as (
  select question_id, id, dl, tf, df from items
  union all select h.question_id, h.id, h.dl, h.tf, pdf.df from hits h join pdf on pdf.question_id = h.question_id where h.tf > 0),
scored as (
  select question_id, id as chunk_id, round(sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) as score
  from every, stats group by question_id, id),
bm as (select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, chunk_id) as rank from scored)"""

LEX_ALL = f"""
qt as (
  select question_id, list(term order by place) as terms from (
    select cast(item_id as bigint) as question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) as place from eval_items)
  where length(term) > 2 and term not in {words(STOP_WORDS)} group by question_id),
qg as (
  select question_id, unnest(range(1, len(terms) + 1)) as i, terms from qt),
grams as (
  select question_id, array_to_string(terms[i:i + 1], ' ') as g, 4 as w from qg where i + 1 <= len(terms)
  union all select question_id, array_to_string(terms[i:i + 2], ' '), 6 from qg where i + 2 <= len(terms)),
lt as (
  select id, term, count(*) as tf from (select id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from {CHUNKS})
  where length(term) > 2 and term not in {words(STOP_WORDS)} group by id, term),
qterms as (select question_id, unnest(terms) as term from qt),
base as (select q.question_id, l.id, sum(least(l.tf, 2)) as s from qterms q join lt l on l.term = q.term group by q.question_id, l.id),
worth as (select g, question_id, sum(w) as w from grams group by g, question_id),
extra as (
  select w.question_id, h.id, sum(w.w) as s from (select g.g, c.id from (select distinct g from grams) g join {CHUNKS} c on contains(lower(c.content), g.g)) h join worth w on w.g = h.g
  group by w.question_id, h.id),
lexed as (select coalesce(b.question_id, e.question_id) as question_id, coalesce(b.id, e.id) as chunk_id, cast(coalesce(b.s, 0) + coalesce(e.s, 0) as double) as score from base b full join extra e on e.question_id = b.question_id and e.id = b.id),
lex as (select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, chunk_id desc) as rank from lexed)"""


def fused(pool: int) -> str:
    return f"""
fused as (
  select coalesce(l.question_id, b.question_id) as question_id, coalesce(l.chunk_id, b.chunk_id) as chunk_id, cast(l.rank as integer) as first_rank, cast(b.rank as integer) as second_rank,
         round(coalesce(cast(1.0 as double) / (60 + l.rank), 0) + coalesce(cast(0.8 as double) / (60 + b.rank), 0), 9) as score
  from (select * from lex where rank <= {pool}) l full join (select * from bm where rank <= {pool}) b on b.question_id = l.question_id and b.chunk_id = l.chunk_id)"""


def without_overlaps(source: str) -> str:
    """left_over: the rows of a table of candidates (question_id, chunk_id, place, score) that the greedy removal of overlaps leaves."""
    return f"""
spans as (
  select s.question_id, s.chunk_id, s.place, s.score, c.document_id, c.page_number,
         {{'chunk_id': s.chunk_id, 'a': coalesce(c.start_offset, 0), 'b': coalesce(c.end_offset, 0), 'content': c.content}} as x
  from {source} s join {CHUNKS} c on c.id = s.chunk_id),
folded as (
  select question_id, document_id, page_number, list_reduce(list([x] order by place), lambda kept, new: case when len(list_filter(kept, lambda k:
    case when k.b <= k.a or new[1].b <= new[1].a then k.content = new[1].content
         else greatest(0, least(k.b, new[1].b) - greatest(k.a, new[1].a)) / least(k.b - k.a, new[1].b - new[1].a) >= 0.6 end)) > 0 then kept else list_concat(kept, new) end) as kept
  from spans group by question_id, document_id, page_number),
left_over as (
  select s.question_id, s.chunk_id, s.place, s.score, s.document_id, s.page_number from spans s
  join (select question_id, unnest(kept).chunk_id as chunk_id from folded) f on f.question_id = s.question_id and f.chunk_id = s.chunk_id)"""


def diverse(limit: int, by: str = "document_id, page_number") -> str:
    """dealt: up to limit rows of left_over for each question, a group at a time, with their position."""
    return f"""
rounds as (
  select *, case when count(*) over (partition by question_id) <= {limit} then 1 else row_number() over (partition by question_id, {by} order by place) end as turn from left_over),
dealt as (
  select * from (select question_id, chunk_id, score, cast(row_number() over (partition by question_id order by turn, place) as integer) as position from rounds) where position <= {limit})"""


def cases(rules: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(question, '{bounded(p)}') then '{name}'" for name, p in rules) + f" else '{otherwise}' end"


IS_CALC = (
    f"(regexp_matches(question, '{bounded(routing.STRONG)}') or (regexp_matches(question, '{bounded(routing.WEAK)}') and (regexp_matches(question, '[0-9]') "
    f"or len(list_intersect(regexp_extract_all(lower(question), '[a-z0-9]+'), {list(routing.QUANTITIES)})) > 0)))"
)
USER = f"(select id as question_id, content as question from {MESSAGES} where lower(trim(role)) = 'user' and content is not null)"
ANSWERED = f"(select a.id as message_id, q.content as question, a.content as answer from {MESSAGES} a join {MESSAGES} q on q.id = a.reply_to_message_id where a.content is not null and q.content is not null)"


def stem(w: str) -> str:
    cut = " ".join(f"when ends_with({w}, '{s}') and length({w}) - {len(s)} >= 3 then left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"(case when regexp_matches({w}, '^[0-9]+$') then {w} when ends_with({w}, 'ies') and length({w}) > 4 then left({w}, length({w}) - 3) || 'y' {cut} else {w} end)"


COVERED = f"""
r as {ANSWERED},
topic as (select distinct message_id, term from (select message_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from r) where length(term) > 2 and term not in {words(EVIDENCE_STOP_WORDS)}),
own as (select distinct message_id, {stem("term")} as s from (select message_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) as term from r)),
n as (
  select r.message_id, count(t.term) as n_terms, count(o.s) as n_covered
  from r left join topic t on t.message_id = r.message_id left join own o on o.message_id = r.message_id and o.s = {stem("t.term")} group by r.message_id)"""

PLACED = "placed as (select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, first_rank asc nulls last, second_rank) as place from fused)"
CANDIDATES = f"{BM25_ALL}, {LEX_ALL}, {fused(40)}, {PLACED}, {without_overlaps('placed')}"
FACT = f"{CANDIDATES}, {diverse(routing.TOP_K['fact'])}"
DEALT = "select question_id, chunk_id, position, score from dealt"

ASKED_CALC = f"(select question_id as item_id, question as text from {USER} where {IS_CALC})"


def over(source: str, sql: str) -> str:
    """The SQL with questions (item_id, text) of another source than the evaluation items."""
    return sql.replace("cast(item_id as bigint)", "item_id").replace("from eval_items", f"from {source}").replace("join eval_items", f"join {source}")


NUMBER = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"
UNIT = "(?:" + "|".join(f"{u}\\b" if u.isalpha() else u for u in sorted(UNITS, key=len, reverse=True)) + ")"
AMOUNT = rf"{NUMBER}(?:\s?{UNIT})?"
YEAR_ONLY = "regexp_matches({0}, '^(?:19|20)\\d{{2}}$')"


def value_of(raw: str) -> str:
    return f"try_cast(regexp_replace(regexp_extract({raw}, '^{NUMBER}'), '[,$%]', '', 'g') as double)"


def unit_of(raw: str) -> str:
    rest = f"lower(trim(substr({raw}, length(regexp_extract({raw}, '^{NUMBER}')) + 1)))"
    return f"(case when {rest} != '' then {rest} when contains({raw}, '%') then '%' when contains({raw}, '$') then 'usd' end)"


#: amount: every number of the lines that name a label, as it is written, with what stands before it. Wants dealt, asked_of.
AMOUNTS = rf"""
labels as (
  select question_id, list(term order by place) as labels from (
    select item_id as question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) as place from asked_of)
  where length(term) > 2 and term not in {words(STOP_WORDS)} and term not in {words(VOCABULARY)} and not regexp_matches(term, '^[0-9]+$') group by question_id),
line as (
  select d.question_id, d.chunk_id, d.position, l.labels, unnest(string_split(regexp_replace(c.content, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) as line,
         unnest(range(len(string_split(regexp_replace(c.content, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))))) as line_no
  from dealt d join {CHUNKS} c on c.id = d.chunk_id join labels l on l.question_id = d.question_id),
named as (select *, list_filter(labels, lambda t: contains(lower(line), t)) as named from line),
marked as (select *, string_split(regexp_replace(line, '(?i)(^|[^A-Za-z0-9])({AMOUNT})', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) as pieces from named where len(named) > 0),
each as (select *, unnest(range(2, len(pieces) + 1)) as k from marked),
amount as (
  select question_id, chunk_id, position, line_no, k, named, string_split(pieces[k], chr(2))[1] as raw, replace(array_to_string(pieces[1:k - 1], ''), chr(2), '') as before from each),
labelled as (
  select question_id, chunk_id, position, line_no, k, raw, {value_of("raw")} as value, {unit_of("raw")} as unit,
         coalesce(list_filter(named, lambda t: contains(lower(before), t))[-1], named[1]) as label
  from amount where {value_of("raw")} is not null and not {YEAR_ONLY.format("raw")} and not regexp_matches(before, '(?i)\b(?:chapter|section|page|pages|figure|fig|table|step|part|item|appendix|no)\.?\s*$'))"""

ASKED_USER = f"(select question_id as item_id, question as text from {USER})"

SQL: dict[str, str] = {
    "scoped_topk": f"""
with {over(ASKED_USER, BM25_ALL)},
cited as (select distinct conversation_id, c.document_id as document_id from (select conversation_id, unnest(citations) as c from (select distinct id, conversation_id, citations from messages))),
placed as (
  select bm.question_id, bm.chunk_id, bm.score from bm join {MESSAGES} m on m.id = bm.question_id join {CHUNKS} c on c.id = bm.chunk_id
  where m.conversation_id not in (select conversation_id from cited where conversation_id is not null) or exists (select 1 from cited x where x.conversation_id = m.conversation_id and x.document_id = c.document_id)),
ranked as (select *, cast(row_number() over (partition by question_id order by score desc, chunk_id) as integer) as rank from placed)
select question_id, chunk_id, score, rank from ranked where rank <= 5""",
    "labelled_amounts": f"with {FACT}, asked_of as (select cast(item_id as bigint) as item_id, text from eval_items), {AMOUNTS} select question_id, chunk_id, label, value, unit from labelled",
    "dedup_greedy": f"with {CANDIDATES} select question_id, chunk_id, score from left_over",
    "diverse_by_page": f"with {FACT} {DEALT}",
    "diverse_by_document": f"with {CANDIDATES}, {diverse(routing.TOP_K['multi_document'], 'document_id')} {DEALT}",
    "extraction_sources": f"with {CANDIDATES}, {diverse(routing.TOP_K['extraction'])} {DEALT}",
    "evidence_chars": f"with {FACT} select d.question_id, count(*) as n_sources, cast(sum(length(c.content)) as bigint) as n_chars from dealt d join {CHUNKS} c on c.id = d.chunk_id group by d.question_id",
    "selection_support": f"""
with {CANDIDATES},
best as (select *, row_number() over (partition by question_id order by place) as spot from left_over),
other as (
  select b.question_id, b.chunk_id, b.spot from best b join {CHUNKS} c on c.id = b.chunk_id join eval_items e on e.item_id = b.question_id
  where b.spot < {routing.TOP_K['selection']} and c.content != e.text)
select cast(item_id as bigint) as question_id, null as chunk_id, 0 as position from eval_items
union all select question_id, chunk_id, cast(row_number() over (partition by question_id order by spot) as integer) from other""",
    "location_lookup": f"""
with {BM25_ALL},
topic as (
  select question_id, term from (select cast(item_id as bigint) as question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from eval_items)
  where length(term) > 2 and term not in {words(STOP_WORDS)}),
sizes as (select question_id, count(*) as n from topic group by question_id),
found as (select * from bm where rank <= 40),
own as (select distinct id, {stem("term")} as s from (select id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from {CHUNKS} where id in (select chunk_id from found))),
k as (select f.question_id, f.chunk_id, f.rank, count(o.s) as k from found f join topic t on t.question_id = f.question_id left join own o on o.id = f.chunk_id and o.s = {stem("t.term")} group by f.question_id, f.chunk_id, f.rank),
about as (select k.* from k join sizes s on s.question_id = k.question_id where k.k >= greatest(1, ceil(s.n * {COVERAGE}::decimal(3,2)))),
found_on as (select question_id, chunk_id, row_number() over (partition by question_id order by rank) as place, cast(count(*) over (partition by question_id) - row_number() over (partition by question_id order by rank) + 1 as double) as score from about),
{without_overlaps('found_on')}, {diverse(routing.TOP_K['location'])} {DEALT}""",
    "topic_is_covered": f"""
with {BM25_ALL}, {LEX_ALL}, {fused(40)},
topic as (select distinct question_id, term from (select cast(item_id as bigint) as question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from eval_items) where length(term) > 2 and term not in {words(EVIDENCE_STOP_WORDS)}),
sizes as (select question_id, count(*) as n from topic group by question_id),
own as (select distinct id, {stem("term")} as s from (select id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from {CHUNKS} where id in (select chunk_id from fused))),
k as (select f.question_id, f.chunk_id, count(o.s) as k from fused f join topic t on t.question_id = f.question_id left join own o on o.id = f.chunk_id and o.s = {stem("t.term")} group by f.question_id, f.chunk_id),
yes as (select k.question_id, bool_or(k.k >= greatest(1, ceil(s.n * {COVERAGE}::decimal(3,2)))) as c from k join sizes s on s.question_id = k.question_id group by k.question_id)
select cast(e.item_id as bigint) as question_id, coalesce(yes.c, false) as is_covered from eval_items e left join yes on yes.question_id = e.item_id""",
    "support_check": rf"""
with r as {ANSWERED},
v as (select distinct message_id, regexp_replace(replace(x, ',', ''), '\.$', '') as x from (select message_id, unnest(regexp_extract_all(answer, '\d[\d,]*(?:\.\d+)?')) as x from r)),
q as (select distinct message_id, regexp_replace(replace(x, ',', ''), '\.$', '') as x from (select message_id, unnest(regexp_extract_all(question, '\d[\d,]*(?:\.\d+)?')) as x from r)),
nv as (select v.message_id, count(*) as n, count(q.x) as k from v left join q on q.message_id = v.message_id and q.x = v.x group by v.message_id),
t as (select distinct message_id, term from (select message_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) as term from r) where length(term) > 2 and term not in {words(EVIDENCE_STOP_WORDS)}),
own as (select distinct message_id, {stem("term")} as s from (select message_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from r)),
nt as (select t.message_id, count(*) as n, count(o.s) as k, count(*) filter (t.term not in ('yes', 'no', 'true', 'false')) as checkable from t left join own o on o.message_id = t.message_id and o.s = {stem("t.term")} group by t.message_id)
select r.message_id, case when nv.n > 0 then nv.k = nv.n when coalesce(nt.checkable, 0) = 0 then true else nt.k >= greatest(1, ceil(nt.n * {COVERAGE}::decimal(3,2))) end as supported
from r left join nv on nv.message_id = r.message_id left join nt on nt.message_id = r.message_id""",
    "chunk_sections": f"""
with sp as ({span_query(PAGES_BLOCKS, "id", "content", False)}),
b as (select id, content, unnest(blocks) as b, unnest(range(len(blocks))) as k from {PAGES_BLOCKS}),
h as (
  select sp.id, sp.chunk_index, arg_max(substr(b.content, b.b.start_offset + 1, b.b.end_offset - b.b.start_offset), b.k) as section
  from sp join b on b.id = sp.id and b.b.is_heading and b.b.start_offset <= sp.end_offset group by sp.id, sp.chunk_index),
o as (
  select sp.id, sp.chunk_index, bool_or(b.b.source_type = 'ocr') as scanned, round(min(b.b.bbox[1]), 2) as box0, round(min(b.b.bbox[2]), 2) as box1, round(max(b.b.bbox[3]), 2) as box2, round(max(b.b.bbox[4]), 2) as box3
  from sp join b on b.id = sp.id and b.b.start_offset < sp.end_offset and b.b.end_offset > sp.start_offset group by sp.id, sp.chunk_index)
select sp.id || '-' || sp.chunk_index as chunk_id, sp.start_offset, sp.end_offset, h.section, case when o.scanned then 'ocr' else 'text' end as source_type, o.box0, o.box1, o.box2, o.box3
from sp left join h on h.id = sp.id and h.chunk_index = sp.chunk_index left join o on o.id = sp.id and o.chunk_index = sp.chunk_index""",
    "phrase_search": f"""
with recursive p as (select * from (values (1, 'in dry conditions'), (2, 'was noted at the'), (3, 'table 2 lists the')) v(phrase_id, needle)),
m as (
  select p.phrase_id, p.needle, t.id, t.content, lower(t.content) as s, strpos(lower(t.content), p.needle) as spot from {PAGES} t, p where strpos(lower(t.content), p.needle) > 0
  union all
  select phrase_id, needle, id, content, s, spot + length(needle) - 1 + strpos(substr(s, spot + length(needle)), needle) from m where strpos(substr(s, spot + length(needle)), needle) > 0)
select phrase_id, id as page_id, cast(spot - 1 as integer) as start_offset, cast(spot - 1 + length(needle) as integer) as end_offset,
       (case when spot - 1 > 60 then '…' else '' end) || substr(content, greatest(spot - 60, 1), least(length(content), spot - 1 + length(needle) + 60) - greatest(spot - 61, 0)) || (case when spot - 1 + length(needle) + 60 < length(content) then '…' else '' end) as snippet
from m""",
    "chunk_spans": span_query(PAGES, "id", "content"),
    "document_spans": span_query("documents", "doc_id", "text"),
    "line_offsets": f"""
with l as (select id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as line_no from {PAGES} where content is not null)
select id as page_id, cast(line_no as integer) as line_no,
       cast(coalesce(sum(length(line) + 1) over w, 0) as integer) as start_offset, cast(coalesce(sum(length(line) + 1) over w, 0) + length(line) as integer) as end_offset
from l window w as (partition by id order by line_no rows between unbounded preceding and 1 preceding)""",
    "term_frequencies": f"""
with p as (select id, term, count(*) as tf from (select id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from {CHUNKS}) group by id, term)
select term, count(*) as df, cast(sum(tf) as bigint) as cf from p group by term""",
    "bm25_topk": f"with {BM25_ALL} select question_id, chunk_id, score, cast(rank as integer) as rank from bm where rank <= 10",
    "lexical_topk": f"with {LEX_ALL} select question_id, chunk_id, score, cast(rank as integer) as rank from lex where rank <= 10",
    "rrf_fuse": f"with {BM25_ALL}, {LEX_ALL}, {fused(10)} select * from fused",
    "merge_sources": f"""
with {BM25_ALL}, {LEX_ALL},
lists as (select question_id, chunk_id, rank, 0 as l from bm where rank <= 10 union all select question_id, chunk_id, rank, 1 from lex where rank <= 10),
f as (select question_id, chunk_id, min(l * 1000 + rank) as spot from lists group by question_id, chunk_id),
p as (select question_id, chunk_id, row_number() over (partition by question_id order by spot, chunk_id) as position from f)
select question_id, chunk_id, cast(position as integer) as position from p where position <= 8""",
    "cosine_topk": """
with s as (
  select q.vec_id as query_id, v.vec_id, round(list_dot_product(cast(q.embedding as double[]), cast(v.embedding as double[])) / sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[])) * list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))), 6) as similarity
  from embeddings q, embeddings v where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s)
select query_id, vec_id, similarity, cast(rank as integer) as rank from r where rank <= 10""",
    "overview_round_robin": f"""
with t as (select id as chunk_id, document_id, page_number, row_number() over (partition by document_id, page_number order by id) as turn from {CHUNKS}),
p as (select *, row_number() over (partition by document_id order by turn, page_number) as position from t)
select document_id, chunk_id, cast(position as integer) as position from p where position <= 10""",
    "coverage_sample": f"""
with c as (select id, document_id, row_number() over (partition by document_id order by page_number, start_offset, id) - 1 as spot, count(*) over (partition by document_id) as n from {CHUNKS} where length(trim(content)) >= 120),
i as (select unnest(range(5)) as k)
select distinct document_id, id as chunk_id from c, i where n <= 5 or spot = least(floor(k * (n / 5.0::double)), n - 1)""",
    "suggestion_sample": f"""
with c as (select id, document_id, page_number, row_number() over (partition by document_id order by page_number) - 1 as spot, count(*) over (partition by document_id) as n from {PAGES} where regexp_matches(content, '[^{SPACE[1:]}')),
i as (select unnest(range(14)) as k)
select distinct document_id, page_number from c, i where n <= 14 or spot = least(floor(k * (n / 14.0::double)), n - 1)""",
    "page_lookup": f"""
with c as {CHUNKS},
p as (select document_id, page_number, count(*) as n from c group by document_id, page_number)
select p.document_id || '-' || p.page_number as asked_id, c.id as chunk_id, cast(case when c.page_number = p.page_number then 1.0 else 0.5 end as double) as score
from p join c on c.document_id = p.document_id and (c.page_number = p.page_number or n < 2 and abs(c.page_number - p.page_number) = 1)""",
    "section_lookup": f"""
with r as (select document_id, id as chunk_id, row_number() over (partition by document_id order by page_number, start_offset, id) as position from {CHUNKS} where contains(lower(section), 'signal'))
select document_id, chunk_id, cast(position as integer) as position from r where position <= 8""",
    "known_sections": "select distinct document_id, section from chunks where section is not null and section != ''",
    "calc_operations": f"select question_id, {cases(routing.OPERATIONS, 'difference')} as operation, {IS_CALC} as is_calculation from {USER}",
    "term_coverage": f"""
with {COVERED}
select message_id, cast(n_terms as integer) as n_terms, cast(case when n_terms = 0 then 0 else greatest(1, ceil(n_terms * {COVERAGE}::decimal(3,2))) end as integer) as n_required, cast(n_covered as integer) as n_covered,
       n_covered >= (case when n_terms = 0 then 0 else greatest(1, ceil(n_terms * {COVERAGE}::decimal(3,2))) end) as is_covered from n""",
    "keyword_coverage": f"""
with r as {ANSWERED},
q as (select message_id, left(term, 5) as s from (select message_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from r) where length(term) > 2 and term not in {words(STOP_WORDS)}),
a as (select distinct message_id, left(term, 5) as s from (select message_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) as term from r) where length(term) > 2 and term not in {words(STOP_WORDS)}),
n as (select r.message_id, count(q.s) as n_points, count(a.s) as n_hits from r left join q on q.message_id = r.message_id left join a on a.message_id = r.message_id and a.s = q.s group by r.message_id)
select message_id, cast(n_points as integer) as n_points, cast(n_hits as integer) as n_hits, n_points > 0 and n_hits * 2 >= n_points as is_covered from n""",
    "page_status_summary": f"""
with s as (select document_id, case when status in ('text', 'ocr', 'empty', 'failed') then status else 'unknown' end as status from {PAGES}),
t as (select document_id, count(*) filter (status = 'text') as text, count(*) filter (status = 'ocr') as ocr, count(*) filter (status = 'empty') as empty, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'unknown') as unknown from s group by document_id)
select d.id as document_id, d.filename, d.status as document_status, d.page_count, coalesce(t.text, 0) as text, coalesce(t.ocr, 0) as ocr, coalesce(t.empty, 0) as empty, coalesce(t.failed, 0) as failed, coalesce(t.unknown, 0) as unknown
from {FILES} d left join t on t.document_id = d.id""",
    "page_classes": rf"""
with a as (
  select document_id, page_number, least(1.0, sum(greatest(0, greatest(0, least(595.0, bbox[3])) - greatest(0, least(595.0, bbox[1]))) * greatest(0, greatest(0, least(842.0, bbox[4])) - greatest(0, least(842.0, bbox[2])))) / (595.0 * 842.0)) as coverage
  from {IMAGES} where bbox is not null group by document_id, page_number),
p as (select p.id, length(regexp_replace(coalesce(p.content, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) as n_chars, round(coalesce(a.coverage, 0), 6) as coverage from {PAGES} p left join a on a.document_id = p.document_id and a.page_number = p.page_number)
select id as page_id, cast(n_chars as bigint) as n_chars, cast(coverage as double) as coverage, case when n_chars >= 40 then 'text' when coverage >= 0.5 then 'needs_ocr' when n_chars > 0 then 'text' else 'empty' end as page_class from p""",
    "figure_counts": f"""
with i as (select document_id, page_number, count(*) as n from {IMAGES} group by document_id, page_number)
select p.id as page_id, coalesce(i.n, 0) as n_figures from {PAGES} p left join i on i.document_id = p.document_id and i.page_number = p.page_number""",
    "decorative_images": f"""
with s as (select document_id, xref, count(distinct page_number) as n_pages from {IMAGES} where xref is not null group by document_id, xref)
select s.document_id, s.xref, s.n_pages from s join {FILES} d on d.id = s.document_id where d.page_count >= 4 and s.n_pages > d.page_count / 2.0""",
    "duplicate_hash": f"""
with f as (select id, first_value(id) over (partition by content_hash order by created_at, id) as first_id from {FILES} where content_hash is not null and status != 'failed')
select id, first_id from f where id != first_id""",
    "chunk_scan": f"""
select d.source, d.filename, count(*) as n_chunks, cast(sum(length(c.content)) as bigint) as n_chars from {CHUNKS} c join {FILES} d on d.id = c.document_id where d.status = 'ready' group by d.source, d.filename""",
    "history_last_n": f"""
with r as (select *, row_number() over (partition by conversation_id order by created_at desc, id desc) as place from {MESSAGES}),
t as (select * from r where place <= 6),
a as (select distinct m.conversation_id, m.id, m.role, m.content from t join {MESSAGES} m on m.id = t.reply_to_message_id and m.conversation_id = t.conversation_id where m.id not in (select id from t))
select conversation_id, id, cast(place as integer) as place, lower(trim(role)) as role, substr(content, 1, 300) as excerpt from t
union all select conversation_id, id, 0, lower(trim(role)), substr(content, 1, 300) from a""",
    "progress_fold": """
with f as (select user_id, event_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) as n from events)
select user_id as session, event_id as seq, event_type as item, count(*) over w as answered, round(sum(value) over w, 6) as score
from f where n = 1 window w as (partition by user_id order by event_id rows between unbounded preceding and current row)""",
    "stream_daily_events": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by date_trunc('day', ts), event_type",
    "stream_session_scores": """
with f as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) as k from events where value is not null)
select user_id as session, count(*) as answered, round(sum(value), 6) as score from f where k = 1 group by user_id""",
    "citations_used": """
with m as (select distinct id, conversation_id, citations from messages),
c as (select conversation_id, unnest(citations) as c from m)
select conversation_id, c.document_id as document_id, count(*) as n_citations, count(distinct c.page_number) as n_pages from c group by conversation_id, c.document_id""",
    "batch_plan": f"""
with r as (select id, row_number() over (partition by document_id order by page_number, start_offset, id) - 1 as place, count(*) over (partition by document_id) as n from {CHUNKS})
select id as chunk_id, cast(place % greatest(1, cast(ceil(n / 10.0) as integer)) as integer) as batch from r""",
    "ascii_token_counts": f"""
with t as (select id, regexp_extract_all(lower(content), '[a-z0-9]+') as t from {PAGES} where content is not null),
d as (select id, count(distinct term) as n from (select id, unnest(t) as term from t) where length(term) > 2 and term not in {words(EVIDENCE_STOP_WORDS)} group by id)
select t.id as page_id, cast(len(t.t) as integer) as n_tokens, cast(coalesce(d.n, 0) as integer) as n_terms from t left join d on d.id = t.id""",
    "toc_heuristic": r"""
with b as (
  select id, document_id, page_number, content, unnest(blocks) as b, unnest(range(len(blocks))) as block_no
  from (select distinct id, document_id, page_number, content, blocks from page_text where blocks is not null)),
h as (
  select document_id, page_number, block_no, trim(substr(content, b.start_offset + 1, b.end_offset - b.start_offset)) as title, round(b.font_size, 1) as size from b where b.is_heading),
g as (select * from h where title != '' and not regexp_matches(title, '(?i)^[\divxlcdm.\-\s]{1,6}$')),
r as (select *, lag(title) over (partition by document_id order by page_number, block_no) as before from g),
k as (select * from r where before is null or before != title)
select document_id, cast(row_number() over (partition by document_id order by page_number, block_no) - 1 as integer) as position, title, page_number,
       cast(least(dense_rank() over (partition by document_id order by size desc), 3) as integer) as level from k""",
}
