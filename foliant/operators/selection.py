"""Choosing among ranked passages: greedy removal of overlaps, diversity, even coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OVERLAP = 0.6


def overlap(a: Column, b: Column) -> Column:
    """Shared characters by the shorter span; passages without a span overlap only if their texts are equal."""
    start, end = (lambda x: F.coalesce(x["start_offset"], F.lit(0))), (lambda x: F.coalesce(x["end_offset"], F.lit(0)))
    shared = F.greatest(F.lit(0), F.least(end(a), end(b)) - F.greatest(start(a), start(b)))
    spanless = (end(a) <= start(a)) | (end(b) <= start(b))
    return F.when(spanless, F.when(a["content"] == b["content"], 1.0).otherwise(0.0)).otherwise(shared / F.least(end(a) - start(a), end(b) - start(b)))


def best_first(sources: DataFrame) -> list[Column]:
    """The order of candidates: by their place in a fusion, if they have one, else by score and id."""
    return [F.asc("place")] if "place" in sources.columns else [F.desc("score"), F.asc("chunk_id")]


def without_overlaps(sources: DataFrame, ratio: float = OVERLAP) -> DataFrame:
    """The passages left after each, from the best down, drops if it overlaps one kept before on its page.

    sources: question_id, chunk_id, document_id, page_number, start_offset, end_offset, content, score and perhaps place.
    A group holds what one question found on one page, at most the size of the candidate pool.
    """
    columns = ["chunk_id", *(c for c in sources.columns if c != "chunk_id")]
    order = F.col("place").cast("double") if "place" in columns else -F.col("score")
    row = F.struct(order.alias("order"), *(c for c in columns if c not in ("question_id", "document_id", "page_number")))
    groups = sources.groupBy("question_id", "document_id", "page_number").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x) >= ratio), kept).otherwise(F.concat(kept, F.array(x)))
    folded = groups.withColumn("kept", F.aggregate(F.expr("slice(rows, 2, size(rows))"), F.slice("rows", 1, 1), keep))
    return folded.select("question_id", "document_id", "page_number", F.explode("kept").alias("k")).select("question_id", "document_id", "page_number", "k.*").drop("order").select(*sources.columns)


def diverse(sources: DataFrame, limit: int, by: tuple[str, ...] = ("document_id", "page_number")) -> DataFrame:
    """Up to limit passages of each question with their position: the best of each group first, then the second best.

    If there are no more passages than the limit, they stay in their order.
    """
    order = best_first(sources)
    rounds = F.row_number().over(W.partitionBy("question_id", *by).orderBy(*order))
    few = F.count("*").over(W.partitionBy("question_id")) <= limit
    turn = sources.withColumns({"_round": rounds, "_few": few}).withColumn("_round", F.when(F.col("_few"), 1).otherwise(F.col("_round")))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("_round", *order))
    return turn.withColumn("position", place).filter(F.col("position") <= limit).drop("_round", "_few")


def overview(chunks: DataFrame, limit: int, scope: str = "document_id") -> DataFrame:
    """Up to limit chunks of each scope, a page at a time: the first chunk of every page, then the second.

    Chunks of a page go by id as text, pages by document and number.
    """
    return in_turn(turns(chunks), limit, scope)


def turns(chunks: DataFrame) -> DataFrame:
    """Chunks with _round, their place on their page by id; each chunk may be there once only."""
    return chunks.withColumn("_round", F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("chunk_id")))


def in_turn(chunks: DataFrame, limit: int, scope: str) -> DataFrame:
    """Up to limit chunks of each scope by their turn, pages by document and number."""
    place = F.row_number().over(W.partitionBy(scope).orderBy("_round", "document_id", "page_number"))
    return chunks.withColumn("position", place).filter(F.col("position") <= limit).drop("_round")


def numbered(rows: DataFrame, scope: str, part: str, order: list[str]) -> DataFrame:
    """rows with at (from 0) and n: the place in the scope, in order of part and then of order, and the scope's size.

    Rows are sorted within (scope, part) only; what stands before a part is a running sum over the parts' counts.
    """
    counts = rows.groupBy(scope, part).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(scope).orderBy(F.col(part).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    counts = counts.withColumns({"_before": before, "_n": F.sum("_c").over(W.partitionBy(scope))}).drop("_c")
    inside = F.row_number().over(W.partitionBy(scope, part).orderBy(*order)) - 1
    left, right = rows.withColumn("_inside", inside).alias("l"), counts.alias("r")
    same = F.col(f"l.{scope}").eqNullSafe(F.col(f"r.{scope}")) & F.col(f"l.{part}").eqNullSafe(F.col(f"r.{part}"))
    return left.join(right, same).select("l.*", (F.col("_inside") + F.col("_before")).alias("at"), F.col("_n").alias("n")).drop("_inside")


def evenly_spaced(rows: DataFrame, limit: int, scope: str, part: str, order: list[str], offset: float = 0.0) -> DataFrame:
    """Up to limit rows of each scope, evenly spaced by position; all, if there are no more than the limit."""
    step = F.col("n") / limit
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.least(F.floor(offset * step + i * step), F.col("n") - 1))
    return numbered(rows, scope, part, order).filter((F.col("n") <= limit) | F.array_contains(picks, F.col("at"))).drop("at", "n")


def merged(primary: DataFrame, secondary: DataFrame, limit: int) -> DataFrame:
    """The first of each chunk from primary, then from secondary, up to limit for each question. Both: question_id, chunk_id, rank."""
    both = primary.select("question_id", "chunk_id", "rank", F.lit(0).alias("list")).unionAll(secondary.select("question_id", "chunk_id", "rank", F.lit(1).alias("list")))
    first = both.groupBy("question_id", "chunk_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("at", "chunk_id"))
    return first.withColumn("position", place).filter(F.col("position") <= limit).select("question_id", "chunk_id", "position")
