"""Aggregates over the library's tables: pages, figures, headings, files, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("text", "ocr", "empty", "failed", "unknown")
#: A page is a text page from so many letters and digits on; else a scan if images cover this share of it.
MIN_CHARS, MIN_COVERAGE = 40, 0.5
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def status_tally(pages: DataFrame) -> DataFrame:
    """document_id and its number of pages by status; a null or other status counts as unknown."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("unknown")
    counted = pages.withColumn("status", known).groupBy("document_id").pivot("status", list(STATUSES)).count()
    return counted.na.fill(0, list(STATUSES))


def documents_with_tally(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Each document with its page tally, zeros if it has no pages."""
    return documents.select(F.col("id").alias("document_id"), "filename", "status", "page_count").join(status_tally(pages), "document_id", "left").na.fill(0, list(STATUSES))


def page_figures(pages: DataFrame, images: DataFrame) -> DataFrame:
    """page_id and its number of figures, zero if none."""
    per_page = images.groupBy("document_id", "page_number").agg(F.count("*").alias("n_figures"))
    return pages.select(F.col("id").alias("page_id"), "document_id", "page_number").join(per_page, ["document_id", "page_number"], "left").select("page_id", F.coalesce("n_figures", F.lit(0)).cast("long").alias("n_figures"))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def decorative(images: DataFrame, documents: DataFrame, least_pages: int = 4) -> DataFrame:
    """document_id, xref of image objects on more than half of the pages of a document of at least four."""
    seen = images.filter("xref is not null").groupBy("document_id", "xref").agg(F.countDistinct("page_number").alias("n_pages"))
    of = documents.select(F.col("id").alias("document_id"), "page_count")
    return seen.join(of, "document_id").filter((F.col("page_count") >= least_pages) & (F.col("n_pages") > F.col("page_count") / 2)).select("document_id", "xref", "n_pages")


def image_coverage(images: DataFrame) -> DataFrame:
    """document_id, page_number and the share of the page that its images cover, at most 1."""
    edge = lambda k, most: F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("bbox")[k]))
    area = F.greatest(F.lit(0.0), edge(2, PAGE_WIDTH) - edge(0, PAGE_WIDTH)) * F.greatest(F.lit(0.0), edge(3, PAGE_HEIGHT) - edge(1, PAGE_HEIGHT))
    return images.filter("bbox is not null").groupBy("document_id", "page_number").agg(F.least(F.lit(1.0), F.sum(area) / (PAGE_WIDTH * PAGE_HEIGHT)).alias("coverage"))


def page_classes(pages: DataFrame, images: DataFrame) -> DataFrame:
    """page_id, n_chars, coverage, page_class: text, needs_ocr or empty, by the first rule that holds."""
    rows = pages.join(image_coverage(images), ["document_id", "page_number"], "left")
    n, share = alnum_count(F.col("content")), F.round(F.coalesce("coverage", F.lit(0.0)), 6)
    kind = F.when(F.col("n_chars") >= MIN_CHARS, "text").when(F.col("coverage") >= MIN_COVERAGE, "needs_ocr").when(F.col("n_chars") > 0, "text").otherwise("empty")
    return rows.select(F.col("id").alias("page_id"), n.cast("long").alias("n_chars"), share.alias("coverage")).withColumn("page_class", kind)


def contents(pages: DataFrame) -> DataFrame:
    """document_id, position, title, page_number, level of each heading.

    Folios and roman numerals are left out, then runs of the same title collapse to their first page; the two largest
    font sizes are levels 1 and 2, all others 3.
    """
    blocks = pages.select("document_id", "page_number", "content", F.posexplode("blocks").alias("block_no", "b")).filter("b.is_heading")
    title = F.trim(F.substring("content", F.col("b.start_offset") + 1, F.col("b.end_offset") - F.col("b.start_offset")))
    rows = blocks.select("document_id", "page_number", "block_no", title.alias("title"), F.round("b.font_size", 1).alias("size")).filter((F.col("title") != "") & ~F.col("title").rlike(r"(?i)^[\divxlcdm.\-\s]{1,6}$"))
    order = W.partitionBy("document_id").orderBy("page_number", "block_no")
    runs = rows.withColumn("before", F.lag("title").over(order)).filter("before is null or before != title")
    return runs.select("document_id", (F.row_number().over(order) - 1).alias("position"), "title", "page_number", F.least(F.dense_rank().over(W.partitionBy("document_id").orderBy(F.desc("size"))), F.lit(3)).alias("level"))


def known_sections(chunks: DataFrame) -> DataFrame:
    """The different section headings of the chunks of each document."""
    return chunks.filter("section is not null and section != ''").select("document_id", "section").distinct()


def duplicate_files(documents: DataFrame) -> DataFrame:
    """id, first_id: files whose content an earlier file that did not fail already has; equal times go by id."""
    kept = documents.filter("content_hash is not null and status != 'failed'")
    first = kept.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("first_id"))
    return kept.join(first, "content_hash").filter("id != first_id").select("id", "first_id")


def recent_turns(messages: DataFrame, n: int = 6, excerpt: int = 300) -> DataFrame:
    """conversation_id, place (1 is the latest), role, excerpt of the last n messages of each conversation."""
    order = W.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = messages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.select("conversation_id", "id", "place", F.lower(F.trim("role")).alias("role"), F.substring("content", 1, excerpt).alias("excerpt"))


def with_anchor(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """turns and the messages they reply to, if of the same conversation and not among them (place 0)."""
    replied = turns.join(messages.select("id", "reply_to_message_id"), "id").filter("reply_to_message_id is not null").select("conversation_id", F.col("reply_to_message_id").alias("id")).distinct()
    missing = replied.join(turns.select("conversation_id", "id"), ["conversation_id", "id"], "left_anti")
    anchors = missing.join(messages.select("conversation_id", "id", F.lit(0).alias("place"), F.lower(F.trim("role")).alias("role"), F.substring("content", 1, 300).alias("excerpt")), ["conversation_id", "id"])
    return turns.unionByName(anchors)


def page_lookup(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked_id, chunk_id, score of the chunks on an asked page (document_id, page_number).

    If only one chunk is on the page, those of the pages before and after follow at half the score; if none is, nothing.
    """
    on = chunks.select("id", "document_id", "page_number")
    per_page = on.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    here = asked.join(per_page, ["document_id", "page_number"])
    wanted = here.select("asked_id", "document_id", "page_number", F.lit(1.0).alias("score"))
    for step in (-1, 1):
        wanted = wanted.unionAll(here.filter("n < 2").select("asked_id", "document_id", F.col("page_number") + step, F.lit(0.5)))
    return wanted.join(on, ["document_id", "page_number"]).select("asked_id", F.col("id").alias("chunk_id"), "score")


def section_lookup(chunks: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """document_id, chunk_id, position of up to limit chunks of each document whose heading contains the needle, in reading order."""
    order = W.partitionBy("document_id").orderBy("page_number", "start_offset", "id")
    hits = chunks.filter(F.contains(F.lower("section"), F.lit(needle.lower())))
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("document_id", F.col("id").alias("chunk_id"), "position")


def running_score(evaluations: DataFrame) -> DataFrame:
    """session, seq, item, answered, score so far: the first evaluation of each item of a session counts, repeats do not.

    evaluations: session, seq, item, points.
    """
    first = evaluations.withColumn("_n", F.row_number().over(W.partitionBy("session", "item").orderBy("seq"))).filter("_n = 1")
    so_far = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return first.select("session", "seq", "item", F.count("*").over(so_far).alias("answered"), F.round(F.sum("points").over(so_far), 6).alias("score"))
