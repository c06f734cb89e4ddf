"""The queries of the numbered problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import answer_defects, leakage, lookalikes, near_duplicates, packing, scan_noise, site_lines, spam_pages
from foliant.runtime import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text columns in which look-alike characters occur."""
    parts = [
        table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.col("id").alias("row_id"), F.col(col).alias("text"))
        for tab, col in (("page_text", "content"), ("chunks", "content"), ("document_images", "caption"))
    ]
    return reduce(DataFrame.unionAll, parts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.defects(table(spark, sf_dir, "page_text"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(table(spark, sf_dir, "page_text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lookalikes.unify(_texts(spark, sf_dir), "text")
    return done.filter("text != unified").select("tab", "row_id").distinct()


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.unify(_texts(spark, sf_dir), "text").select("tab", "row_id", F.col("unified").alias("text")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.site_lines(table(spark, sf_dir, "page_text"), table(spark, sf_dir, "pdf_documents"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_text").select("id", "document_id", "content").distinct()
    return site_lines.cleaned(pages, p3_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects.defects(table(spark, sf_dir, "messages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "chunks"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "chunks"))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep to: all texts in, whole, no window overfull, one in a hundred bins and one for each group to spare."""
    windows = table(spark, sf_dir, "context_windows")
    found = packing.fill(p6_windows(spark, sf_dir), windows)
    spare = F.ceil(F.col("least_bins") / 100) + F.ceil(F.col("texts") / packing.GROUP)
    return found.select("window_id", "texts", "gaps", "overfull", (F.col("bins") <= F.col("least_bins") + spare).alias("is_full"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = spam_pages.spam_share(table(spark, sf_dir, "documents"))
    return shares.filter(F.col("spam_share") > spam_pages.SHARE).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


P3_FOUND = r"""
with lines as (
  select p.id as page_id, p.document_id, d.source, unnest(string_split(p.content, chr(10))) as line,
         unnest(range(len(string_split(p.content, chr(10))))) as line_no
  from (select distinct id, document_id, content from page_text where regexp_matches(content, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) p
  join (select distinct id, source from pdf_documents where source is not null) d on d.id = p.document_id),
forms as (
  select *, lower(trim(regexp_replace(line, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) as form from lines),
sizes as (select source, count(distinct document_id) as n from forms group by source),
often as (
  select f.source, f.form from forms f join sizes s on s.source = f.source where length(f.form) >= 20
  group by f.source, f.form, s.n having count(distinct f.document_id) >= 3 and count(distinct f.document_id) * 100 >= 15 * s.n)
select distinct f.page_id, cast(f.line_no as integer) as line_no from forms f join often o on o.source = f.source and o.form = f.form
"""


LATIN = r"[a-zA-Z\x{c0}-\x{24f}]"
P2_FOUND = rf"""
with t as (
  select 'page_text' as tab, id as row_id, content as text from page_text
  union all select 'chunks', id, content from chunks
  union all select 'document_images', id, caption from document_images)
select distinct tab, row_id from t
where nfc_normalize(text) != text
   or regexp_matches(text, '[\x{{ad}}\x{{34f}}\x{{61c}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{2069}}\x{{feff}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{fb00}}-\x{{fb06}}\x{{ff01}}-\x{{ff5e}}\x{{1d400}}-\x{{1d7ff}}]')
   or regexp_matches(text, '{LATIN}[{"".join(lookalikes.HOMOGLYPHS)}]|[{"".join(lookalikes.HOMOGLYPHS)}]{LATIN}')
"""
P5_FOUND = r"""
with c as (select distinct id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from chunks where content is not null),
s as (select distinct id, array_to_string(w[i:i + 2], ' ') as x from (select id, w, unnest(range(1, len(w) - 1)) as i from c where len(w) >= 20)),
n as (select id, count(*) as n from s group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as k from s a join s b on b.x = a.x and a.id < b.id group by a.id, b.id)
select p.id_a, p.id_b from p join n a on a.id = p.id_a join n b on b.id = p.id_b where p.k >= 0.6 * (a.n + b.n - p.k)
"""
P7_FOUND = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dg as (select doc_id, array_to_string(w[k:k + 11], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ig as (select item_id, array_to_string(w[k:k + 11], ' ') as x from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct dg.doc_id, ig.item_id from dg join ig on ig.x = dg.x
union
select d.doc_id, i.item_id from d join i on len(i.w) between 1 and 11 and contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
"""


P6_KEPT = """
select w.window_id, (select count(distinct doc_id) from documents) as texts, cast(0 as bigint) as gaps, false as overfull, true as is_full
from (select distinct window_id from context_windows where capacity_tokens > 0) w
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_kept": P6_KEPT, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p7_found": P7_FOUND}
