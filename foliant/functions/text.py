"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ranking ignores, and those that checks of evidence ignore.
STOP_WORDS = "a an and are about the of for in is it to was what which with this that".split()
EVIDENCE_STOP_WORDS = STOP_WORDS + "how does do on".split()
# Endings that are cut off, in this order.
SUFFIXES = ("ing", "ers", "er", "ions", "ion", "es", "ed", "ly", "s")
#: Share of a topic's words that a passage must have to be about it.
COVERAGE = 0.6
# Lower-case letters with accents and the letters they fold to.
ACCENTED, FOLDED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöōőřśšťùúûüūůűýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiiilnnnooooooorsstuuuuuuuyyzzz"


def collapsed(text: Column) -> Column:
    """White space, in the Unicode sense, as single blanks; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; accented letters cut a run."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def terms(text: Column) -> Column:
    """Tokens of more than two characters that are no stop words, in order and with repeats."""
    return F.filter(ascii_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def significant_terms(text: Column) -> Column:
    """Different content words in order of first use."""
    return F.array_distinct(F.filter(ascii_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(EVIDENCE_STOP_WORDS)))


def stemmed(text: Column) -> Column:
    """Every ASCII word of a lower-case text without the first ending that leaves three letters; -ies becomes y.

    The y is written large between the two steps, so that the second does not cut it again.
    """
    edge, stop = "(?<![a-zA-Z0-9])", "(?![a-zA-Z0-9])"
    plural = F.regexp_replace(text, f"{edge}([a-z0-9]{{2,}})ies{stop}", "$1Y")
    return F.lower(F.regexp_replace(plural, f"{edge}([a-z0-9]{{3,}}?)(?:{'|'.join(SUFFIXES)}){stop}", "$1"))


def stems(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(stemmed(F.lower(text)), F.lit("([a-z0-9]+)"), 1))


def covered_count(topic_terms: Column, text_stems: Column) -> Column:
    """How many of the topic's terms (repeats count) the text has, by stem.

    text_stems should be a column of its own, not an expression: it would be computed for each term.
    """
    own = F.split(stemmed(F.array_join(topic_terms, " ")), " ")  # all terms at once, not one by one
    return F.size(F.filter(own, lambda s: (s != "") & F.array_contains(text_stems, s)))


def required_count(topic_terms: Column) -> Column:
    n = F.size(topic_terms)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n * F.lit(COVERAGE).cast("decimal(3,2)")).cast("int")))


def covers(topic_terms: Column, text_stems: Column) -> Column:
    """Whether the text is about the topic; a topic without terms is covered by anything."""
    return covered_count(topic_terms, text_stems) >= required_count(topic_terms)


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script in lower case, accents folded: the words of the keyword index."""
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), ACCENTED, FOLDED)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)


def numbers_in(text: Column) -> Column:
    """Different numbers of a text, without thousands separators and final points."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.$", "")))
