"""From pages to chunks: offsets of lines, spans that end at sentences, section labels and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from foliant.functions.text import collapsed

SIZE, OVERLAP = 900, 150
#: A sentence end is used only if it lies more than so many characters behind the chunk's start.
LEAST = 300


def spans_of(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk: the last sentence end inside the window, if far enough in, else the whole window."""
    at, total = 0, len(text)
    while at < total:
        stop = min(total, at + size)
        if stop < total:
            full_stop = text.rfind(". ", at, stop)
            stop = full_stop + 1 if full_stop > at + LEAST else stop
        yield at, stop
        at = total if stop >= total else max(stop - overlap, at + 1)


def chunk_spans(texts: DataFrame, key: str = "id", text: str = "content", collapse: bool = True, size: int = SIZE, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, chunk_index, start_offset, end_offset and the carried columns: each start depends on the end before, so a text is cut in one task.

    Null and blank texts have no chunks. Offsets count code points, of the text with white space collapsed if asked.
    """
    value = collapsed(F.col(text)) if collapse else F.col(text)
    source = texts.select(F.col(key).alias("key"), value.alias("text"), *carry).filter("text is not null and text != ''")

    @F.pandas_udf("array<struct<start_offset:int,end_offset:int>>")
    def spans(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [{"start_offset": a, "end_offset": b} for a, b in spans_of(t, size, overlap)])

    cut = source.select("key", *carry, F.posexplode(spans("text")).alias("chunk_index", "span"))
    return cut.select(F.col("key").alias(key), "chunk_index", "span.start_offset", "span.end_offset", *carry)


def union_box(boxes: Column) -> Column:
    """The box around boxes, rounded to hundredths; null of none."""
    edge = lambda k, pick: F.round(pick(F.transform(boxes, lambda b: b[k])), 2)
    box = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    return F.when(F.size(boxes) > 0, box)


def touching(blocks: Column, start: Column, end: Column) -> Column:
    """The blocks that share a character with a half-open range."""
    return F.filter(blocks, lambda b: (b["start_offset"] < end) & (b["end_offset"] > start))


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, page id, offsets, section, bbox, source_type of each chunk of each page.

    The section is the last heading that begins at or before the chunk's end; a chunk that touches a scanned block is scanned.
    """
    joined = chunk_spans(pages, "id", "content", False, size, overlap, ("content", "blocks"))
    headings = F.filter("blocks", lambda b: b["is_heading"] & (b["start_offset"] <= F.col("end_offset")))
    last = F.element_at(headings, -1)
    met = touching(F.col("blocks"), F.col("start_offset"), F.col("end_offset"))
    return joined.select(
        F.concat_ws("-", "id", "chunk_index").alias("chunk_id"),
        F.col("id").alias("page_id"),
        "start_offset",
        "end_offset",
        F.when(F.size(headings) > 0, F.substring("content", last["start_offset"] + 1, last["end_offset"] - last["start_offset"])).alias("section"),
        union_box(F.transform(met, lambda b: b["bbox"])).alias("bbox"),
        F.when(F.exists(met, lambda b: b["source_type"] == "ocr"), "ocr").otherwise("text").alias("source_type"),
    )


@F.pandas_udf(ArrayType(IntegerType()))
def running_ends(lengths: pd.Series) -> pd.Series:
    """Where each line ends, if one character stands between lines."""
    return lengths.map(lambda n: None if n is None else np.cumsum(np.asarray(n, np.int64) + 1) - 1)


def line_offsets(pages: DataFrame) -> DataFrame:
    """page_id, line_no, start_offset, end_offset of each line: lengths add up within the row."""
    lengths = F.transform(F.split("content", "\n", -1), lambda x: F.length(x))
    rows = pages.select("id", lengths.alias("n")).withColumn("end", running_ends("n"))
    rows = rows.select(F.col("id").alias("page_id"), F.posexplode(F.arrays_zip("n", "end")).alias("line_no", "x"))
    return rows.select("page_id", "line_no", (F.col("x.end") - F.col("x.n")).alias("start_offset"), F.col("x.end").alias("end_offset"))
