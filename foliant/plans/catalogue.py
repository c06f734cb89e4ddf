"""The registered queries over the library's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import providers
from foliant.functions.text import ascii_tokens, significant_terms, terms
from foliant.operators import calculation, chunking, grounding, library, ranking, selection
from foliant.plans import modes, routing
from foliant.plans.sql import SQL
from foliant.runtime import checkpoint, table
from foliant.sources import corpus
from foliant.streaming import feeds

#: Phrases that phrase_search looks for.
PHRASES = ((1, "in dry conditions"), (2, "was noted at the"), (3, "Table 2 lists the"))
HEADING = "signal"
LIMIT = 5


def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_spans(corpus.pages(spark, sf))


def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_spans(table(spark, sf, "documents"), "doc_id", "text")


def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.page_chunks(corpus.pages(spark, sf))
    return rows.select("chunk_id", "start_offset", "end_offset", "section", "source_type", *(F.col("bbox")[k].alias(f"box{k}") for k in range(4)))


def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.line_offsets(corpus.pages(spark, sf))


def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    counted = ranking.term_counts(corpus.chunks(spark, sf))
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bm25(corpus.chunks(spark, sf), corpus.questions(spark, sf), 10)


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.lexical(corpus.chunks(spark, sf), corpus.questions(spark, sf), 10)


def scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunks by BM25 for users' messages, each asked of the documents that its conversation cites, if it cites any."""
    return ranking.bm25(corpus.chunks(spark, sf), _scoped(spark, sf), 5)


def answer_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The passages for users' messages, each routed to its mode and asked of the documents that its conversation cites."""
    return modes.answers(corpus.chunks(spark, sf), _scoped(spark, sf))


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The users' messages as questions with the documents that their conversation cites as scope."""
    cited = corpus.messages(spark, sf).select("conversation_id", F.explode("citations").alias("c")).groupBy("conversation_id").agg(F.collect_set("c.document_id").alias("scope"))
    of = corpus.messages(spark, sf).select(F.col("id").alias("question_id"), "conversation_id").join(cited, "conversation_id", "left").drop("conversation_id")
    return _asked(spark, sf).join(of, "question_id")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ranking.cosine(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    chunks, questions = corpus.chunks(spark, sf), corpus.questions(spark, sf)
    return ranking.fused(ranking.lexical(chunks, questions, 10), ranking.bm25(chunks, questions, 10))


def dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return selection.without_overlaps(modes.candidates(corpus.chunks(spark, sf), corpus.questions(spark, sf))).select("question_id", "chunk_id", "score")


def diverse_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return modes.fact(corpus.chunks(spark, sf), corpus.questions(spark, sf))


def diverse_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return modes.multi_document(corpus.chunks(spark, sf), corpus.questions(spark, sf))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Passages for each question by fusion of BM25 with the vectors of an embedding provider."""
    chunks, questions = corpus.chunks(spark, sf), corpus.questions(spark, sf)
    return modes.fact(chunks, questions, modes.similar_chunks(chunks, questions, providers.hashed_words))


def extraction_sources(spark: SparkSession, sf: str) -> DataFrame:
    return modes.extraction(corpus.chunks(spark, sf), corpus.questions(spark, sf))


def location_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return modes.location(corpus.chunks(spark, sf), corpus.questions(spark, sf))


def selection_support(spark: SparkSession, sf: str) -> DataFrame:
    return modes.selection_first(corpus.chunks(spark, sf), corpus.questions(spark, sf))


def overview_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.chunks(spark, sf).select(F.col("id").alias("chunk_id"), "document_id", "page_number")
    return selection.overview(rows, 10).select("document_id", "chunk_id", "position")


def coverage_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.chunks(spark, sf).filter(F.length(F.trim("content")) >= 120).select("id", "document_id", "page_number", "start_offset")
    return selection.evenly_spaced(rows, LIMIT, "document_id", "page_number", ["start_offset", "id"]).select("document_id", F.col("id").alias("chunk_id"))


def suggestion_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.pages(spark, sf).filter(F.col("content").rlike(r"(?U)\S")).select("id", "document_id", "page_number")
    return selection.evenly_spaced(rows, 14, "document_id", "page_number", ["id"]).select("document_id", "page_number")


def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus.chunks(spark, sf)
    asked = chunks.select("document_id", "page_number").distinct().select(F.concat_ws("-", "document_id", "page_number").alias("asked_id"), "document_id", "page_number")
    return library.page_lookup(chunks, asked)


def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return library.section_lookup(corpus.chunks(spark, sf), HEADING)


def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    phrases = spark.createDataFrame(PHRASES, "phrase_id int, phrase string")
    return grounding.phrase_matches(corpus.pages(spark, sf), phrases).select("phrase_id", "page_id", "start_offset", "end_offset", "snippet")


def toc_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return library.contents(corpus.pages(spark, sf))


def known_sections(spark: SparkSession, sf: str) -> DataFrame:
    return library.known_sections(corpus.chunks(spark, sf))


def route_mode(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(_asked(spark, sf), corpus.chunks(spark, sf).select("section").filter("section is not null"))


def calc_operations(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("question")
    return _asked(spark, sf).select("question_id", calculation.operation(q).alias("operation"), routing.is_calculation(q).alias("is_calculation"))


def labelled_amounts(spark: SparkSession, sf: str) -> DataFrame:
    questions = corpus.questions(spark, sf)
    chunks = corpus.chunks(spark, sf)
    found = modes.fact(chunks, questions).select("question_id", "chunk_id")
    labels = questions.select("question_id", calculation.label_terms(F.col("question")).alias("labels"))
    passages = found.join(labels, "question_id").join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    return calculation.labelled_amounts(passages).select("question_id", "chunk_id", "label", "value", "unit")


def calc_results(spark: SparkSession, sf: str) -> DataFrame:
    """The calculations that users' messages ask for, from the question or from the passages found for it."""
    asked = _asked(spark, sf).filter(routing.is_calculation(F.col("question")))
    chunks = corpus.chunks(spark, sf)
    found = checkpoint(modes.calculation(chunks, asked)).join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    return calculation.results(asked, found)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The users' messages as questions."""
    rows = corpus.messages(spark, sf).filter((F.lower(F.trim("role")) == "user") & F.col("content").isNotNull())
    return rows.select(F.col("id").alias("question_id"), F.col("content").alias("question"))


def term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.topic_coverage(_answered(spark, sf), "question", "answer").drop("question", "answer")


def support_check(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).select("message_id", grounding.supported(F.col("answer"), F.col("question")).alias("supported"))


def keyword_coverage(spark: SparkSession, sf: str) -> DataFrame:
    stem5 = lambda c: F.array_distinct(F.transform(terms(F.col(c)), lambda t: F.substring(t, 1, 5)))
    asked = F.transform(terms(F.col("question")), lambda t: F.substring(t, 1, 5))
    rows = _answered(spark, sf).select("message_id", asked.alias("points"), stem5("answer").alias("given"))
    hits = F.size(F.filter("points", lambda s: F.array_contains(F.col("given"), s)))
    return rows.select("message_id", F.size("points").alias("n_points"), hits.alias("n_hits"), ((F.size("points") > 0) & (hits * 2 >= F.size("points"))).alias("is_covered"))


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with the message they reply to: message_id, question, answer."""
    rows = corpus.messages(spark, sf)
    replies = rows.filter("reply_to_message_id is not null and content is not null").select(F.col("id").alias("message_id"), F.col("content").alias("answer"), F.col("reply_to_message_id").alias("id"))
    return replies.join(rows.filter("content is not null").select("id", F.col("content").alias("question")), "id").select("message_id", "question", "answer")


def page_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return library.documents_with_tally(corpus.documents(spark, sf), corpus.pages(spark, sf)).withColumnRenamed("status", "document_status")


def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    return library.page_classes(corpus.pages(spark, sf), corpus.images(spark, sf))


def figure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return library.page_figures(corpus.pages(spark, sf), corpus.images(spark, sf))


def decorative_images(spark: SparkSession, sf: str) -> DataFrame:
    return library.decorative(corpus.images(spark, sf), corpus.documents(spark, sf))


def duplicate_hash(spark: SparkSession, sf: str) -> DataFrame:
    return library.duplicate_files(corpus.documents(spark, sf))


def chunk_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of ready documents with their file's name."""
    ready = corpus.documents(spark, sf).filter("status = 'ready'").select(F.col("id").alias("document_id"), "filename", "source")
    return corpus.chunks(spark, sf).join(ready, "document_id").groupBy("source", "filename").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.messages(spark, sf)
    return library.with_anchor(library.recent_turns(rows), rows)


def progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("item"), F.col("value").alias("points"))
    return library.running_score(rows)


def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    chunks, questions = corpus.chunks(spark, sf), corpus.questions(spark, sf)
    return selection.merged(ranking.bm25(chunks, questions, 10), ranking.lexical(chunks, questions, 10), 8)


def citation_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where each chunk's text stands in its page."""
    pages = corpus.pages(spark, sf).select("document_id", "page_number", F.regexp_replace("content", "\n", " ").alias("page"))
    rows = corpus.chunks(spark, sf).select(F.col("id").alias("chunk_id"), "document_id", "page_number", "content")
    placed = grounding.located(rows.join(pages, ["document_id", "page_number"]), "content", "page")
    return placed.select("chunk_id", "found", "at", "to")


def citation_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Where on its page each chunk can be shown, and how surely."""
    boxes = grounding.cited_boxes(corpus.chunks(spark, sf).select(F.col("id").alias("chunk_id"), "document_id", "page_number", "content", "bbox"), corpus.pages(spark, sf))
    return boxes.select("chunk_id", "box_source", *(F.col("box")[k].alias(f"box{k}") for k in range(4)))


def topic_is_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any of the passages found for a question is about it."""
    questions, chunks = corpus.questions(spark, sf), corpus.chunks(spark, sf)
    found = modes.candidates(chunks, questions).select("question_id", "chunk_id").join(questions, "question_id").withColumn("topic", significant_terms(F.col("question")))
    each = modes.covered(found, chunks).select("question_id", F.col("is_covered").alias("c"))
    return questions.select("question_id").join(each.groupBy("question_id").agg(F.max("c").alias("c")), "question_id", "left").select("question_id", F.coalesce("c", F.lit(False)).alias("is_covered"))


def evidence_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of evidence that each question's passages hold."""
    found = modes.fact(corpus.chunks(spark, sf), corpus.questions(spark, sf)).select("question_id", "chunk_id")
    texts = corpus.chunks(spark, sf).select(F.col("id").alias("chunk_id"), F.length("content").alias("n"))
    return found.join(texts, "chunk_id").groupBy("question_id").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_chars"))


def citations_used(spark: SparkSession, sf: str) -> DataFrame:
    """The documents cited in each conversation, with the pages of each."""
    cited = corpus.messages(spark, sf).select("conversation_id", F.explode("citations").alias("c")).select("conversation_id", "c.document_id", "c.page_number")
    return cited.groupBy("conversation_id", "document_id").agg(F.count("*").alias("n_citations"), F.countDistinct("page_number").alias("n_pages"))


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of each document dealt to even batches of at most five questions: every batch gets each n-th passage."""
    rows = selection.numbered(corpus.chunks(spark, sf).select("id", "document_id", "page_number", "start_offset"), "document_id", "page_number", ["start_offset", "id"])
    batches = F.greatest(F.lit(1), F.ceil(F.col("n") / 10)).cast("int")
    return rows.select(F.col("id").alias("chunk_id"), F.pmod(F.col("at"), batches).cast("int").alias("batch"))


def ascii_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.pages(spark, sf).filter("content is not null")
    return rows.select(F.col("id").alias("page_id"), F.size(ascii_tokens(F.col("content"))).alias("n_tokens"), F.size(significant_terms(F.col("content"))).alias("n_terms"))


def stream_daily_events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.run(feeds.daily_events(feeds.stream(spark, f"{sf}/events.parquet")), "complete").drop("batch")


def stream_session_scores(spark: SparkSession, sf: str) -> DataFrame:
    events = feeds.stream(spark, f"{sf}/events.parquet").filter("value is not null")
    rows = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("item"), F.col("value").alias("points"))
    updates = feeds.run(feeds.session_scores(rows), "update")
    return updates.groupBy("session").agg(F.max_by(F.struct("answered", "score"), "batch").alias("x")).select("session", "x.answered", "x.score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chunk_spans, document_spans, chunk_sections, line_offsets, term_frequencies, bm25_topk, lexical_topk, scoped_topk, answer_plan, cosine_topk, rrf_fuse, dedup_greedy,
        diverse_by_page, diverse_by_document, hybrid_topk, extraction_sources, location_lookup, selection_support, overview_round_robin, coverage_sample,
        suggestion_sample, page_lookup, section_lookup, phrase_search, toc_heuristic, known_sections, route_mode, calc_operations, labelled_amounts, calc_results,
        term_coverage, support_check, keyword_coverage, page_status_summary, page_classes, figure_counts, decorative_images, duplicate_hash,
        chunk_scan, history_last_n, progress_fold, merge_sources, citation_places, citation_boxes, topic_is_covered, evidence_chars, citations_used, batch_plan,
        ascii_token_counts, stream_daily_events, stream_session_scores,
    )
}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in QUERIES}
