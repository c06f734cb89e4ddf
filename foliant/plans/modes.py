"""Ways of answering: from ranked candidates to the passages an answer may rest on, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import providers
from foliant.functions.text import covers, stems, terms
from foliant.operators import ranking, selection
from foliant.plans.routing import TOP_K, route
from foliant.runtime import checkpoint

SPAN = ("document_id", "page_number", "start_offset", "end_offset", "content")


def with_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with the place and text of their chunks; only now does text join in."""
    return ranked.join(chunks.select(F.col("id").alias("chunk_id"), *SPAN), "chunk_id")


def hashed(chunks: DataFrame) -> DataFrame:
    """Chunks with a hash of 128 bits in place of their text: enough to see which texts are equal, and short to send."""
    return chunks.withColumn("content", F.md5("content"))


def candidates(chunks: DataFrame, questions: DataFrame, pool: int = ranking.POOL, similar: DataFrame | None = None, short: bool = False) -> DataFrame:
    """Candidates of each question by fusion of two rankings: that of vectors if one is given, else of lexical overlap, and BM25.

    similar: question_id, chunk_id, rank of an embedding provider's nearest chunks. place is the order in the fusion:
    equal scores go by the first ranking, then by the second. short: content is a hash of the text.
    """
    first = similar if similar is not None else ranking.lexical(chunks, questions, pool)
    fused = ranking.fused(first, ranking.bm25(chunks, questions, pool))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), "second_rank"))
    return with_text(fused.withColumn("place", place).select("question_id", "chunk_id", "score", "place"), hashed(chunks) if short else chunks)


def similar_chunks(chunks: DataFrame, questions: DataFrame, provider: Callable[[list[str]], list[list[float]]], pool: int = ranking.POOL) -> DataFrame:
    """question_id, chunk_id, rank of the chunks nearest to each question by an embedding provider."""
    asked = providers.embedded(questions, "question_id", "question", provider, providers.INSTRUCTION)
    near = ranking.cosine(providers.embedded(chunks, "id", "content", provider), asked, pool)
    return near.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("chunk_id"), "rank")


def answered(chunks: DataFrame, questions: DataFrame, mode: str, by: tuple[str, ...], similar: DataFrame | None = None) -> DataFrame:
    left = selection.without_overlaps(candidates(chunks, questions, similar=similar, short=True))
    return selection.diverse(left, TOP_K[mode], by).select("question_id", "chunk_id", "position", "score")


def fact(chunks: DataFrame, questions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    return answered(chunks, questions, "fact", ("document_id", "page_number"), similar)


def multi_document(chunks: DataFrame, questions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    return answered(chunks, questions, "multi_document", ("document_id",), similar)


def extraction(chunks: DataFrame, questions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    return answered(chunks, questions, "extraction", ("document_id", "page_number"), similar)


def calculation(chunks: DataFrame, questions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    return answered(chunks, questions, "calculation", ("document_id", "page_number"), similar)


def covered(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs (chunk_id, topic: array of terms) with is_covered; each chunk is stemmed once, whatever asks for it."""
    own = chunks.select(F.col("id").alias("chunk_id"), stems(F.col("content")).alias("stems"))
    return pairs.join(own, "chunk_id").withColumn("is_covered", covers(F.col("topic"), F.col("stems"))).drop("stems")


def location(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Passages that have enough of a question's terms, by BM25 alone; none where no passage does."""
    about = covered(ranking.bm25(chunks, questions).join(questions.select("question_id", terms(F.col("question")).alias("topic")), "question_id"), chunks)
    about = with_text(about.filter("is_covered"), hashed(chunks))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("rank"))
    total = F.count("*").over(W.partitionBy("question_id"))
    scored = about.withColumns({"score": (total - place + 1).cast("double"), "place": place}).select("question_id", "chunk_id", *SPAN, "score", "place")
    return selection.diverse(selection.without_overlaps(scored), TOP_K["location"]).select("question_id", "chunk_id", "position", "score")


def selection_first(chunks: DataFrame, selections: DataFrame) -> DataFrame:
    """The selected text itself at position 0, then the best that supports it, without passages whose text is the selection.

    selections: question_id, question (the selected text). A passage that is the selection takes a place among the best.
    """
    own = selections.select("question_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("position"))
    left = selection.without_overlaps(candidates(chunks, selections))
    best = left.withColumn("_at", F.row_number().over(W.partitionBy("question_id").orderBy("place"))).filter(F.col("_at") < TOP_K["selection"])
    rows = best.join(selections.select("question_id", F.col("question").alias("own")), "question_id").filter(F.col("content") != F.col("own"))
    kept = rows.withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy("_at")))
    return own.unionAll(kept.select("question_id", "chunk_id", "position"))


def scoped(plan: DataFrame) -> DataFrame:
    """The questions with a scope, a row for each document of it (document_id)."""
    return plan.filter(F.size("scope") > 0).withColumn("document_id", F.explode(F.array_distinct("scope"))).drop("scope")


def unscoped(plan: DataFrame) -> DataFrame:
    """The questions without a scope, which is all documents."""
    return plan.filter(F.coalesce(F.size("scope"), F.lit(0)) <= 0).drop("scope")


def pages(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """The chunks of the page each question names, in reading order; if it has but one, then those of the pages around.

    Questions with a scope meet the chunks of its documents; of those without, each page is answered once.
    """
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number", "start_offset")
    reading = (F.coalesce("start_offset", F.lit(0)), "document_id", "page_number", "chunk_id")
    limit = TOP_K["page"]

    def of(asked: DataFrame, key: str, *by: str) -> DataFrame:
        steps = asked.withColumn("step", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))))
        near = steps.withColumn("page_number", F.col("page") + F.col("step")).join(place, [*by, "page_number"])
        # of the page itself no more than limit are kept, of the pages around as many more at most
        first = near.withColumn("around", F.col("step") != 0).withColumn("position", F.row_number().over(W.partitionBy(key, "around").orderBy(*reading))).filter(F.col("position") <= limit)
        counted = first.withColumn("own", F.sum(F.when(F.col("around"), 0).otherwise(1)).over(W.partitionBy(key)))
        kept = counted.filter((F.col("own") > 0) & (~F.col("around") | (F.col("own") == 1)))
        return kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("around", *reading))).filter(F.col("position") <= limit).select(key, "chunk_id", "position")

    named = unscoped(plan).select("question_id", "page")
    asked = named.select("page").distinct().withColumn("named", F.col("page"))
    whole = of(asked, "named").withColumnRenamed("named", "page")
    return of(scoped(plan).select("question_id", "page", "document_id"), "question_id", "document_id").unionByName(named.join(whole, "page").drop("page"))


def sections(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """The chunks under headings that hold the section each question names, in reading order.

    The section's first word must be a word of the heading. Questions with a scope meet the chunks of its documents; of
    those without, each section is sought once, by that word.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    asked = plan.select("question_id", "scope", F.lower("section").alias("needle"), F.get(words(F.col("section")), F.lit(0)).alias("word"))
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number", "start_offset", "section").filter("section is not null")
    holds = F.contains(F.lower("section"), F.col("needle"))

    def first(hits: DataFrame, key: str) -> DataFrame:
        order = W.partitionBy(key).orderBy("document_id", "page_number", F.coalesce("start_offset", F.lit(0)), "chunk_id")
        return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= TOP_K["section"]).select(key, "chunk_id", "position")

    own = first(scoped(asked).join(place, "document_id").filter(holds & F.array_contains(words(F.col("section")), F.col("word"))), "question_id")
    named = unscoped(asked)
    headings = place.select("section").distinct().select("section", F.explode(F.array_distinct(words(F.col("section")))).alias("word"))
    met = named.select("needle", "word").distinct().join(headings, "word").filter(holds).select("needle", "section")
    return own.unionByName(named.select("question_id", "needle").join(first(met.join(place, "section"), "needle"), "needle").drop("needle"))


def answers(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, mode, chunk_id, position: each question is routed, and its passages are found in the way of its mode.

    questions: question_id, question, and optionally scope (documents it is asked of). One fusion of rankings serves all
    modes that rest on it; a section that no heading holds is sought by fusion too.
    """
    asked = questions if "scope" in questions.columns else questions.withColumn("scope", F.lit(None).cast("array<string>"))
    routed = route(asked.select("question_id", "question", F.size("scope").alias("n_documents")), chunks.select("section").filter("section is not null"))
    plan = checkpoint(asked.select("question_id", "question", "scope").join(routed.select("question_id", "mode", "page", "topic", "section", "top_k"), "question_id"))
    of = lambda *modes: plan.filter(F.col("mode").isin(*modes))
    named = checkpoint(sections(chunks, of("section")))
    unnamed = of("section").join(named, "question_id", "left_anti").withColumn("question", F.concat_ws(" ", "section", "question"))
    fused = of("fact", "multi_document", "calculation", "extraction").unionByName(unnamed)
    left = checkpoint(selection.without_overlaps(candidates(chunks, fused.select("question_id", "question", "scope"), short=True)).drop("content").join(fused.select("question_id", "mode"), "question_id"))
    found = [named, pages(chunks, of("page")), location(chunks, of("location").select("question_id", F.col("topic").alias("question"), "scope")).select("question_id", "chunk_id", "position")]
    for mode, by in (("fact", ("document_id", "page_number")), ("multi_document", ("document_id",)), ("calculation", ("document_id", "page_number")), ("extraction", ("document_id", "page_number"))):
        found.append(selection.diverse(left.filter(F.col("mode") == mode), TOP_K[mode], by).select("question_id", "chunk_id", "position"))
    best = left.filter("mode = 'section'").withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy("place")))
    found.append(best.filter(F.col("position") <= TOP_K["section"]).select("question_id", "chunk_id", "position"))
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number")
    own = scoped(of("overview").select("question_id", "scope")).join(selection.turns(place), "document_id")  # turns are those of a page, whoever asks
    found.append(selection.in_turn(own, TOP_K["overview"], "question_id").select("question_id", "chunk_id", "position"))
    whole = selection.overview(place.withColumn("mode", F.lit("overview")), TOP_K["overview"], "mode").select("mode", "chunk_id", "position")  # ten rows
    found.append(unscoped(of("overview")).join(F.broadcast(whole), "mode").select("question_id", "chunk_id", "position"))
    every = reduce(DataFrame.unionByName, found)
    return every.join(plan.select("question_id", "mode"), "question_id").select("question_id", "mode", "chunk_id", "position")
