"""Readers of the corpus tables and of files, with schemas given and never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import table

#: Parsers of document files by suffix: bytes -> one (page_number, content) for each page.
PARSERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {}
MAGIC = "%PDF-"


def register_parser(suffix: str, parser: Callable[[bytes], list[tuple[int, str]]]) -> None:
    """Make a file format readable; the parser goes to the tasks by value, or by name if they can import it."""
    PARSERS[suffix.lower()] = parser


def unique(rows: DataFrame, key: str = "id") -> DataFrame:
    """Each key once, by one shuffle into as many parts as the session sets: much work on few bytes is to stay spread."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, each id once."""
    return unique(table(spark, sf_dir, "chunks"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each id once."""
    return unique(table(spark, sf_dir, "page_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the library, each id once."""
    return unique(table(spark, sf_dir, "pdf_documents"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "document_images"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "messages"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of questions: question_id, question."""
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("long").alias("question_id"), F.col("text").alias("question"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path: path, filename, length, content_hash (SHA-256), is_pdf (by its first kilobyte), content."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return read.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "length",
        F.sha2("content", 256).alias("content_hash"),
        (F.locate(MAGIC, F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) > 0).alias("is_pdf"),
        "content",
    )


def file_pages(found: DataFrame) -> DataFrame:
    """path, page_number, content, error of each page of the files, by the parser of the file's suffix.

    A file that cannot be parsed gives one row with the error and no page, and never fails the others.
    """
    parsers = dict(PARSERS)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parser = parsers.get("." + path.rsplit(".", 1)[-1].lower())
                try:
                    if parser is None:
                        raise ValueError("no parser for this format")
                    rows += [(path, n, text, None) for n, text in parser(bytes(content))]
                except Exception as error:  # noqa: BLE001 - one bad file must not fail the rest
                    rows.append((path, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "page_number", "content", "error"]).astype({"page_number": "Int32"})

    return found.select("path", "content").mapInPandas(part, "path string, page_number int, content string, error string")
