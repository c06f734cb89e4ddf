"""Problem 3: lines that one site repeats over and over.

Lines are parsed into templates through a token tree of fixed depth: a line goes to the leaf named by its source, its
number of tokens and its first tokens (numbers become wildcards); inside a leaf it joins the most similar template,
whose differing tokens become wildcard slots. Leaves that too few documents of the source reach drop out first. In the rest each
batch of lines grows its own trees; their templates travel as rows and are merged leaf by leaf as they stream by, and
behind the templates of a leaf come its different lines and are assigned to them. A leaf with more than HOT different
lines is split by its next tokens, so no task gets more than its share. Templates that cover too few documents drop
out, the rest are checked exactly.

Nothing is lost on the way: a leaf is a function of the line alone, so a leaf's number of documents (summed over
batches) is never less than that of any line in it; and after the merge each different line is assigned to a template
once, so a template's number of documents is never less than that of a line it holds.

Cases: null or blank content has no lines and does not count as a page of its document; a document without a row in
the documents table, or with a null source, has no source and none of its lines is found; repeated rows count once;
extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import checkpoint, small_side

MIN_CHARS, MIN_DOCUMENTS, MIN_SHARE = 20, 3, 0.15
#: Tokens of a line that name its leaf, and the share of equal tokens at which it joins a template.
DEPTH, SIMILAR = 3, 0.5
WILD = "<*>"
#: Different lines of a leaf from which on it is split by the BEYOND tokens that follow.
HOT, BEYOND = 50_000, 4


def same_form(line: str) -> str:
    """The form in which lines are compared: trimmed, white space as one blank, lower case."""
    return " ".join(line.split()).lower()


def tokens_of(form: str) -> list[str]:
    return [WILD if any(c.isdigit() for c in t) else t for t in form.split(" ")]


def leaf_of(source: str, tokens: list[str], depth: int = DEPTH) -> int:
    """The leaf of the tree: source, number of tokens, first tokens."""
    return hash64("\t".join((source, str(len(tokens)), *tokens[:depth])))


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def best_template(tokens: list[str], templates: Iterable[list[str]]) -> int:
    """The position of the most similar template (ties: the first), or -1 if none is similar enough."""
    best, at = SIMILAR * len(tokens), -1
    for k, template in enumerate(templates):
        same = sum(a == b or b == WILD for a, b in zip(tokens, template, strict=True))
        if same > best or at < 0 and same == best:
            best, at = same, k
    return at


def generalised(a: list[str], b: list[str]) -> list[str]:
    return [x if x == y else WILD for x, y in zip(a, b, strict=True)]


def leaf_documents(pages: DataFrame) -> DataFrame:
    """leaf, source, documents: how many documents of a batch have lines in the leaf; sums never fall short."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves: dict[int, tuple[str, set[str]]] = {}
            for document, source, content in batch.itertuples(index=False, name=None):
                for form in set(map(same_form, content.split("\n"))):
                    if len(form) >= MIN_CHARS:
                        leaf = leaf_of(source, tokens_of(form))
                        leaves.setdefault(leaf, (source, set()))[1].add(document)
            yield pd.DataFrame([(leaf, source, len(d)) for leaf, (source, d) in leaves.items()], columns=["leaf", "source", "documents"])

    return pages.select("document_id", "source", "content").mapInPandas(part, "leaf long, source string, documents int")


def trees(forms: DataFrame) -> DataFrame:
    """leaf, text: the templates of the token trees that each batch of different lines grows. forms: leaf, form."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a batch's tree is given out at once, so memory stays bounded
            leaves: dict[int, list[list[str]]] = defaultdict(list)
            for leaf, form in batch.itertuples(index=False, name=None):
                grow(leaves[leaf], tokens_of(form))
            yield pd.DataFrame([(leaf, " ".join(t)) for leaf, ts in leaves.items() for t in ts], columns=["leaf", "text"])

    return forms.select("leaf", "form").mapInPandas(part, "leaf long, text string")


def grow(templates: list[list[str]], tokens: list[str]) -> None:
    """Let a line, or a template of another tree, join the template it is most similar to, or begin one."""
    at = best_template(tokens, templates)
    if at < 0:
        templates.append(tokens)
    else:
        templates[at] = generalised(templates[at], tokens)


def split_hot(lines: DataFrame) -> DataFrame:
    """lines with the leaf that each meets its templates in: its own, or the deeper one if that has too many different lines."""
    hot = lines.select("leaf", "form").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    leaf = F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.col("deep"))
    return lines.join(small_side(hot), "leaf", "left").withColumn("leaf", leaf).drop("deep", "n")


def assigned(forms: DataFrame) -> DataFrame:
    """form, leaf, template: the merged template that each different line belongs to, as a number within the leaf."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, templates = None, []
        for batch in batches:
            rows = []
            for at, is_line, text in batch.itertuples(index=False, name=None):
                if at != leaf:
                    leaf, templates = at, []
                if is_line:
                    rows.append((text, at, best_template(tokens_of(text), templates)))
                else:
                    grow(templates, text.split(" "))
            yield pd.DataFrame(rows, columns=["form", "leaf", "template"])

    templates = trees(forms).distinct().select("leaf", F.lit(False).alias("is_line"), "text")
    both = templates.unionAll(forms.select("leaf", F.lit(True), F.col("form")))
    ordered = both.repartition("leaf").sortWithinPartitions("leaf", "is_line", "text")
    return ordered.mapInPandas(part, "form string, leaf long, template int")


def lines_of(pages: DataFrame) -> DataFrame:
    """Each line that can count: page_id, line_no, document_id, source, leaf, form, and the leaf it has if its own is split."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, document, source, content in batch.itertuples(index=False, name=None):
                for k, line in enumerate(content.split("\n")):
                    form = same_form(line)
                    if len(form) >= MIN_CHARS:
                        tokens = tokens_of(form)
                        rows.append((page, k, document, source, leaf_of(source, tokens), form, leaf_of(source, tokens, DEPTH + BEYOND)))
            yield pd.DataFrame(rows, columns=["page_id", "line_no", "document_id", "source", "leaf", "form", "deep"])

    return pages.select("page_id", "document_id", "source", "content").mapInPandas(part, "page_id string, line_no int, document_id string, source string, leaf long, form string, deep long")


def with_source(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Non-blank pages with the source of their document."""
    of = documents.select(F.col("id").alias("document_id"), "source").filter("source is not null").dropDuplicates(["document_id"])
    kept = pages.select(F.col("id").alias("page_id"), "document_id", "content").filter(F.col("content").rlike(r"(?U)\S"))
    return kept.join(small_side(of), "document_id")


def site_lines(pages: DataFrame, documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, line_no of each line that its source repeats in min_documents and min_share of its documents or more."""
    pages = with_source(pages, documents)
    share = F.ceil(F.countDistinct("document_id") * F.lit(str(min_share)).cast("decimal(9,6)"))
    needed = small_side(pages.groupBy("source").agg(F.greatest(F.lit(min_documents), share).alias("needed")))
    leaves = leaf_documents(pages).groupBy("leaf", "source").agg(F.sum("documents").alias("n")).join(needed, "source").filter("n >= needed").select("leaf")
    lines = checkpoint(lines_of(pages).join(small_side(leaves), "leaf", "left_semi"))
    lines = split_hot(lines)
    lines = checkpoint(lines.join(assigned(lines.select("leaf", "form").distinct()), ["leaf", "form"]).join(needed, "source"))
    covering = lines.groupBy("leaf", "template", "needed").agg(F.countDistinct("document_id").alias("n")).filter("n >= needed").select("leaf", "template")
    of = lines.join(covering, ["leaf", "template"], "left_semi")
    repeated = of.groupBy("source", "form", "needed").agg(F.countDistinct("document_id").alias("n")).filter("n >= needed").select("source", "form")
    return of.join(repeated, ["source", "form"], "left_semi").select("page_id", "line_no").distinct()


def cleaned(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with the found lines taken out of content, every other line as it is."""
    gone = found.groupBy(F.col("page_id").alias("id")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("content", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"])), lambda s: s["x"]), "\n")
    return pages.join(gone, "id", "left").withColumn("content", F.when(F.col("_gone").isNull(), F.col("content")).otherwise(kept)).drop("_gone")
