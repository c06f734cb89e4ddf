"""Checks of answers and topics against the passages they rest on."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import covered_count, covers, numbers_in, required_count, significant_terms, stems
from foliant.operators.chunking import touching, union_box

RADIUS = 60


def topic_coverage(pairs: DataFrame, topic: str = "question", passage: str = "content") -> DataFrame:
    """pairs with n_terms, n_required, n_covered, is_covered of the topic in the passage."""
    terms = significant_terms(F.col(topic))
    rows = pairs.withColumns({"_terms": terms, "_stems": stems(F.col(passage))})
    out = {"n_terms": F.size("_terms"), "n_required": required_count(F.col("_terms")), "n_covered": covered_count(F.col("_terms"), F.col("_stems")), "is_covered": covers(F.col("_terms"), F.col("_stems"))}
    return rows.withColumns(out).drop("_terms", "_stems")


def supported(value: Column, passage: Column) -> Column:
    """Whether the passage supports a value: it has all of its numbers, or, if there are none, enough of its words.

    A bare yes or no cannot be checked and counts as supported.
    """
    numbers, terms = numbers_in(value), significant_terms(value)
    unverifiable = F.size(F.array_except(terms, F.array(*map(F.lit, ("yes", "no", "true", "false"))))) == 0
    return F.when(F.size(numbers) > 0, F.size(F.array_except(numbers, numbers_in(passage))) == 0).when(unverifiable, True).otherwise(covers(terms, stems(passage)))


def phrase_matches(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every occurrence, without regard to case, of each phrase: phrase_id, page_id, offsets, snippet, bbox.

    phrases (phrase_id, phrase) is a stated set. Pages are first matched by containment, then split at the phrase, so
    the text is read once for all phrases of a page.
    """
    asked = phrases.select("phrase_id", F.lower(F.trim(F.regexp_replace("phrase", r"(?U)\s+", " "))).alias("needle")).filter("needle != ''")
    known = asked.sparkSession.sparkContext.broadcast([(r["phrase_id"], r["needle"]) for r in asked.collect()])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, content in zip(batch["id"], batch["content"], strict=True):
                low = content.lower()
                if len(low) != len(content):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
                for phrase, needle in known.value:
                    at = low.find(needle)
                    while at >= 0:
                        to = at + len(needle)
                        a, b = max(0, at - RADIUS), min(len(content), to + RADIUS)
                        rows.append((phrase, page, at, to, ("…" if a else "") + content[a:b] + ("…" if b < len(content) else "")))
                        at = low.find(needle, to)
            yield pd.DataFrame(rows, columns=["phrase_id", "page_id", "start_offset", "end_offset", "snippet"])

    kind = dict(phrases.dtypes)["phrase_id"]
    found = pages.select("id", "content").filter("content is not null").mapInPandas(part, f"phrase_id {kind}, page_id string, start_offset int, end_offset int, snippet string")
    boxes = found.join(pages.select(F.col("id").alias("page_id"), "blocks"), "page_id")
    met = touching(F.col("blocks"), F.col("start_offset"), F.col("end_offset"))
    return boxes.withColumn("bbox", union_box(F.transform(met, lambda b: b["bbox"]))).drop("blocks")


def located(pairs: DataFrame, needle: str = "excerpt", text: str = "content") -> DataFrame:
    """pairs with found (exact, approximate, none), at, to of the excerpt in the text.

    Not found as it is, the longest common run counts if it has 20 characters and half of the excerpt.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [place(n, t) for n, t in zip(batch[needle], batch[text], strict=True)]
            yield batch.assign(found=[o[0] for o in out], at=[o[1] for o in out], to=[o[2] for o in out])

    return pairs.mapInPandas(part, f"{fields}, found string, at int, to int")


def place(needle: str | None, text: str | None) -> tuple[str, int, int]:
    """Where an excerpt stands in a text, whatever its case and the white space in it: as it is, else its longest common run."""
    needle = " ".join((needle or "").split())
    if not needle or not text:
        return "none", -1, -1
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    sought = "".join(c.lower() if len(c.lower()) == 1 else c for c in needle)
    at = low.find(sought)
    if at >= 0:
        return "exact", at, at + len(needle)
    run = difflib.SequenceMatcher(None, low, sought, autojunk=False).find_longest_match()
    return ("approximate", run.a, run.a + run.size) if run.size >= max(20, len(needle) // 2) else ("none", -1, -1)


def cited_boxes(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """cited with box and box_source: the passage's own box (exact), that of the blocks its text touches (approximate), or none (unavailable).

    cited: document_id, page_number, content, bbox. Only passages without a box meet their pages' text.
    """
    has = F.coalesce(F.size("bbox"), F.lit(0)) > 0
    own = cited.filter(has).withColumns({"box": F.col("bbox"), "box_source": F.lit("exact")})
    of = pages.select("document_id", "page_number", F.col("content").alias("_page"), F.col("blocks").alias("_blocks"))
    sought = located(cited.filter(~has).join(of, ["document_id", "page_number"], "left"), "content", "_page")
    met = touching(F.col("_blocks"), F.col("at"), F.col("to"))
    box = F.when(F.col("found") != "none", union_box(F.transform(met, lambda b: b["bbox"])))
    rest = sought.withColumn("box", box).withColumn("box_source", F.when(F.col("box").isNotNull(), "approximate").otherwise("unavailable"))
    return own.unionByName(rest.select(*own.columns))
