"""Which way a question is answered, and in which form: ordered rules as column expressions over many questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import terms

# Patterns of questions. (?U) makes word boundaries those of all scripts.
FLAGS = "(?iU)"
PAGE = r"\bpage\s+(\d{1,4})\b"
END = r"[\?\.!]*$"
LOCATIONS = (
    r"\bwhere\s+is\s+the\s+definition\s+of\s+(.+?)" + END,
    r"\bwhere\s+is\s+(.+?)\s+(?:explained|defined|discussed|mentioned|described|located|found|covered)\b",
    r"\bwhere\s+(?:does|do)\s+(?:the\s+)?(?:document|pdf|file|text)?\s*(?:discuss(?:es)?|mention(?:s)?|talk(?:s)?\s+about|cover(?:s)?|explain(?:s)?|describe(?:s)?)\s+(.+?)" + END,
    r"\bwhich\s+page[s]?\s+(?:discusses?|mentions?|covers?|explains?|talks?\s+about|describes?)\s+(.+?)" + END,
    r"\bwhere\s+can\s+i\s+find\s+(.+?)" + END,
    r"\bwhere\s+is\s+(?:the\s+)?(.+?)" + END,
)
TRAILING = r"\s+in\s+(?:this|the)\s+(?:document|pdf|file|text)$"
EACH = r"\bfor\s+(?:each|every)\b"
STRONG = r"percentage\s+(?:increase|decrease)|percent\s+(?:increase|decrease)|\bgrowth\s+rate\b|\bratio\s+of\b|\baverage\s+of\b|\bhow\s+much\s+(?:more|less|higher|lower)\b|\bpercent(?:age)?\s+change\b"
WEAK = r"\b(?:percentage|percent|ratio|average|difference|sum|total|increase[ds]?|decrease[ds]?)\b"
QUANTITIES = (
    "revenue cost costs price prices sales profit margin amount count weight distance speed rate score value values size temperature age salary "
    "budget expense expenses income population rating quantity number duration length width height volume capacity throughput latency bandwidth "
    "frequency voltage current power efficiency accuracy growth loss gain return"
).split()
SECTION_CUE = r"\bsection\b|\bchapter\b"
GENERIC_SECTIONS = "introduction conclusion abstract background methodology methods results discussion references appendix preface".split()
GENERIC = r"\bthe\s+(" + "|".join(GENERIC_SECTIONS) + r")\b"
NAMED = r"\bthe\s+([a-z][a-z0-9\-/ ]{1,45}?)\s+section\b"
DISCUSSED = r"\bwhat\s+(?:does|do)\s+(?:the\s+)?([a-z0-9][a-z0-9\-/ ]{1,45}?)\s+(?:discuss|say|cover|talk about|explain)\b"
BROAD = (
    r"\b(?:brief(?: me)?|summar(?:y|ize|ise)|overview|outline|main idea|main point|key (?:point|takeaway)s?|what(?:'?s| is) (?:this|the) (?:document|pdf|file) about|"
    r"what (?:is|does) (?:this|the) (?:document|pdf|file) (?:cover|contain)|tell me about this (?:document|pdf|file)|topics covered|table of contents|tl;?dr|"
    r"give (?:me )?(?:a |an )?(?:summary|overview|brief|breakdown))\b"
)
FORMATS = (
    ("table", r"\btabl(?:e|es|ular|ulate)\b|\bcompar(?:e|ison|ing|isons)\b|\bversus\b|\bvs\.?\b"),
    ("bullets", r"\bbullet|\bpoint[- ]?wise\b|\bin points\b|\blist (?:them|these|it)\b|\bas a list\b"),
    ("sectioned", r"section[- ]?wise|section by section|by section|chapter[- ]?wise|breakdown by section"),
    ("summary", r"\bsummar(?:y|ize|ise)\b|\bbrief(?:ly)?\b|\btl;?dr\b|\bconcise(?:ly)?\b|\bshort(?:er)? version\b"),
)
OPERATIONS = (
    ("percentage_increase", r"percentage\s+increase|percent\s+increase|\bincrease[ds]?\b"),
    ("percentage_decrease", r"percentage\s+decrease|percent\s+decrease|\bdecrease[ds]?\b"),
    ("percentage", r"\bpercentage\b|\bpercent\b|%"),
    ("ratio", r"\bratio\b"),
    ("average", r"\baverage\b|\bmean\b"),
    ("sum", r"\bsum\b|\btotal\b"),
    ("difference", r"\bdifference\b"),
    ("comparison", r"\bcompare\b|\bcomparison\b|\bhow\s+much\s+(?:more|less|higher|lower)\b"),
)
#: How many passages each way of answering takes.
TOP_K = {"selection": 6, "multi_document": 12, "page": 8, "location": 6, "extraction": 20, "calculation": 6, "section": 8, "overview": 10, "fact": 8}


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def first_of(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The name of the first rule whose pattern occurs in the text."""
    return reduce(lambda out, rule: F.when(matches(text, rule[1]), rule[0]).otherwise(out), reversed(rules), F.lit(otherwise))


def group(text: Column, pattern: str) -> Column:
    """The pattern's first group, trimmed, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, FLAGS + pattern, 1)), F.lit(""))


def location_topic(question: Column) -> Column:
    """What a question asks the place of; null if it does not ask for a place."""
    found = F.coalesce(*(group(question, p) for p in LOCATIONS))
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_replace(found, r"^[?.! ]+|[?.! ]+$", "")), FLAGS + TRAILING, "")), F.lit(""))


def is_calculation(question: Column) -> Column:
    names_quantity = F.arrays_overlap(terms(question), F.array(*map(F.lit, QUANTITIES)))
    return matches(question, STRONG) | (matches(question, WEAK) & (question.rlike("[0-9]") | names_quantity))


def has_cue(question: Column) -> Column:
    """Whether a question may be about a section; only then is a heading sought in it."""
    return matches(question, SECTION_CUE) | matches(question, GENERIC) | matches(question, DISCUSSED)


def named_sections(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """question_id, heading: the longest known heading that occurs in the question and whose first word is a word of it (ties: the first by name).

    Questions meet headings of four words or more by the heading's second and third, which stand between others and so
    are words of the question too, others by the first: no question is compared with every heading that begins alike.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    w = F.col("words")
    known = sections.select("section").distinct().withColumn("words", words(F.col("section"))).filter(F.size("words") > 0)
    known = known.select("section", w[0].alias("first"), F.when(F.size("words") >= 4, F.concat_ws(" ", F.slice("words", 2, 2))).otherwise(w[0]).alias("key"))
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), lambda x, k: F.concat_ws(" ", x, F.get(w, k + 1)))
    asked = questions.select("question_id", "question", words(F.col("question")).alias("words"))
    keys = asked.withColumn("key", F.explode(F.array_distinct(F.concat("words", pairs))))
    hits = keys.join(known, "key").filter(F.contains(F.lower("question"), F.lower("section")) & F.array_contains("words", F.col("first")))
    return hits.groupBy("question_id").agg(F.min_by("section", F.struct(-F.length("section"), F.col("section"))).alias("heading"))


def route(questions: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """question_id, mode, format, page, topic, section, top_k of each question.

    questions: question_id, question, and optionally selected_text and n_documents.
    """
    q = F.col("question")
    rows = questions
    for name, kind in (("selected_text", "string"), ("n_documents", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if sections is None:
        rows = rows.withColumn("heading", F.lit(None).cast("string"))
    else:
        rows = rows.join(named_sections(questions.filter(has_cue(q)), sections), "question_id", "left")
    section = F.when(has_cue(q), F.coalesce("heading", group(q, GENERIC), group(q, NAMED), group(q, DISCUSSED)))
    is_location = reduce(Column.__or__, (matches(q, p) for p in LOCATIONS))
    mode = (
        F.when(F.col("selected_text").rlike(r"(?U)\S"), "selection")
        .when(F.col("n_documents") > 1, "multi_document")
        .when(matches(q, PAGE), "page")
        .when(is_location, "location")
        .when(matches(q, EACH), "extraction")
        .when(is_calculation(q), "calculation")
        .when(F.col("_section").isNotNull(), "section")
        .when(matches(q, BROAD), "overview")
        .otherwise("fact")
    )
    k = F.create_map(*(F.lit(x) for pair in TOP_K.items() for x in pair))
    out = rows.withColumn("_section", section).withColumn("mode", mode)
    only = lambda m, value: F.when(F.col("mode") == m, value)
    return out.select(
        "question_id",
        "mode",
        first_of(q, FORMATS, "default").alias("format"),
        only("page", F.regexp_extract("question", FLAGS + PAGE, 1)).cast("int").alias("page"),
        only("location", F.coalesce(location_topic(q), q)).alias("topic"),
        only("section", F.col("_section")).alias("section"),
        k[F.col("mode")].alias("top_k"),
    )
