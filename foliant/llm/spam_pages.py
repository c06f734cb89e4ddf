"""Problem 8: pages of stuffed keywords and lists of links, category paths or product tags.

Texts are cut into windows of WINDOW words. A window is described by its densities (links, separators, commas, digits,
marks of tables and citations), the entropy and repetition of its words, and its share of function words. Per language,
the centre is the median and the scatter the covariance of the windows that lie near the centre by median absolute
deviations. The robust Mahalanobis distance of a window from it is taken along the directions of spam: the deviation,
whitened by the scatter, is projected on the whitened direction. A window that lies farther than CUTOFF along one of
them is spam, if every feature of the direction deviates the way it points and the numbers and marks of tables,
references and contents lists do not. A document is spam where such windows hold more than half of its text.

Every window of every document enters the statistics. Only the statistics of a few languages reach the driver.

Cases: null, empty and very short texts (under LEAST words) are not spam; the language is counted from function words,
since the given one may be null or wrong, and falls back to the given one; texts of no known language are judged by the
statistics of all windows, at every size; a language's own statistics count by its windows against PRIOR windows of all,
without a switch; repeated rows give one result; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliant.llm.words import WORD
from foliant.runtime import checkpoint

# Frequent function words of the languages. Articles are not among them: names in a list have them too.
FUNCTION_WORDS = {
    "en": "and or of in on at to for from by with without that this it its is are was were be not no as so than then when while because although neither nor which who how why what where each every both our your their they we you he she his her has have had can cannot only".split(),
    "de": "und oder nicht kein keine in im an am auf zu zum zur von vom mit ohne bei für aus über unter nach vor zwischen während weil wenn als dass obwohl sowohl auch wie um nur ist sind war wird werden hat haben sich es er sie wir ihr".split(),
    "fr": "de d et ou ne pas en dans sur sous au aux à par pour avec sans que qui quand comme bien tandis où est sont était ce cette ces son sa ses il elle on nous vous ils elles plus entre selon".split(),
    "es": "de y o no en a al por para con sin que quien cuando como aunque mientras donde es son era está este esta estos su sus se lo más entre según durante tras tanto sobre".split(),
}
WINDOW, LEAST = 30, 5
#: Documents are spam when flagged windows hold more than this share of their characters.
SHARE = 0.5
#: Distance along a direction of spam beyond which a window is an outlier: the 0.9993 quantile of a normal deviation.
CUTOFF = 3.2
FEATURES = ("function", "repeated", "entropy", "links", "separators", "commas", "digits", "marks", "sentences")
#: Least standard deviation of each feature; most windows have none of some of them.
FLOOR = dict(zip(FEATURES, (0.03, 0.04, 0.015, 0.03, 0.02, 0.03, 0.04, 0.02, 0.02), strict=True))
#: Directions of spam: of each feature its part in the direction, in scatter units, and how far it must deviate that way itself.
DIRECTIONS = (
    {"function": (-1.0, 1.0)},  # keywords, tags and paths strung together without grammar
    {"repeated": (1.0, 3.0), "entropy": (-1.0, 3.0)},  # the same phrase over and over
    {"links": (1.0, 1.0), "function": (-0.3, 1.0)},
    {"sentences": (-1.0, 1.0), "function": (-1.0, 1.0)},
    {"separators": (1.0, 1.0), "function": (-1.0, 1.0)},
    {"commas": (1.0, 1.0), "function": (-0.3, 1.0)},
)
#: Marks of tables, references and contents lists beyond this deviation point away from spam.
AWAY = 3.0
LINK = re.compile(r"<a\b[^>]*>[^<]*</a>|<[^<>]*>|\[[^\]\n]*\]\([^)\s]*\)?|https?://\S+|www\.\S+|\w[\w.-]*\.\w+/\S*")
MARK = re.compile(r"\(\d{4}\)|\d\(\d+\)|^\s*\[\d+\]|[;\t|]\s?\d|\.{4,}|(?:\. ){3,}|\d+-\d+", re.M)
TOKEN = re.compile(rf"(?P<link>{LINK.pattern})|{WORD.pattern}")
#: Texts without any of these have no marks.
MARKED = re.compile(r"[(\[;|\t]|\d-\d|\.\.\.|\. \. ")
RUNS = re.compile(rf"(?:{WORD.pattern}+[\W_]*+){{1,{WINDOW}}}+")
KNOWN = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}
#: The function words of a text of no known language.
ANY = frozenset().union(*KNOWN.values())
STOPS = (". ", ".\n", "! ", "!\n", "? ", "?\n")
SEPARATORS = "»>#|›→/·•;"
#: Texts without any of these have no links.
HINT = re.compile(r"://|www\.|\]\(|<|\.\w+/")


def language(found: Counter, given: str | None) -> str:
    hits = {lang: sum(map(found.__getitem__, found.keys() & words)) for lang, words in KNOWN.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] >= 3:
        return best
    return given if given in FUNCTION_WORDS else "und"


def cut(text: str) -> list[tuple[str, list[str], int, int]]:
    """(text outside links, its words, number of links, characters with links) of each window of WINDOW words or links."""
    if HINT.search(text):
        spans = [(m.start(), m.end(), m.lastgroup == "link") for m in TOKEN.finditer(text)]
        starts = list(range(0, max(1, len(spans) - WINDOW // 2), WINDOW))
        out = []
        for k, at in enumerate(starts):
            to = starts[k + 1] if k + 1 < len(starts) else len(spans)
            lo, hi = (0 if k == 0 else spans[at][0]), (spans[to][0] if to < len(spans) else len(text))
            linked = [(a, b) for a, b, link in spans[at:to] if link]
            piece = "".join(text[a:b] for a, b in zip([lo, *(b for _, b in linked)], [*(a for a, _ in linked), hi], strict=True))
            out.append((piece, [text[a:b].lower() for a, b, link in spans[at:to] if not link], len(linked), hi - lo))
        return out if len(spans) >= LEAST else []
    pieces = RUNS.findall(text)
    if not pieces:
        return []
    if (lead := text.find(pieces[0])) > 0:
        pieces[0] = text[:lead] + pieces[0]
    split = [WORD.findall(p.lower()) for p in pieces]
    if len(pieces) > 1 and len(split[-1]) <= WINDOW // 2:
        pieces[-2:], split[-2:] = [pieces[-2] + pieces[-1]], [split[-2] + split[-1]]
    return [(p, w, 0, len(p)) for p, w in zip(pieces, split, strict=True)] if len(split[0]) >= LEAST else []


def windows(text: str, given: str | None) -> Iterator[tuple]:
    """(language, characters, features...) of each window of a text."""
    there = cut(text)
    if not there:
        return
    lang = language(Counter(w for _, own, _, _ in there for w in own), given)
    function = KNOWN.get(lang, ANY)
    for piece, own, links, chars in there:
        n = len(own) + links  # a link is one token, unlike any other
        counts = Counter(own)
        repeats = sum(c * math.log2(c) for c in counts.values() if c > 1)
        digits = sum(c for w, c in counts.items() if not w.isalpha())
        yield (
            lang,
            chars,
            len(function & counts.keys()) / n,
            1 - (len(counts) + links) / n,
            1 - repeats / n / math.log2(n) if n > 1 else 1.0,
            (chars - len(piece)) / chars,
            sum(map(piece.count, SEPARATORS)) / n,
            piece.count(",") / n,
            digits / n,
            len(MARK.findall(piece)) / n if MARKED.search(piece) else 0.0,
            (sum(map(piece.count, STOPS)) + piece.endswith((".", "!", "?"))) / n,
        )


def measured(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, chars and the features of each window."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *w) for i, t, lang in batch.itertuples(index=False, name=None) if t for w in windows(t, lang)]
            yield pd.DataFrame(rows, columns=["id", "lang", "chars", *FEATURES])

    kind = dict(documents.dtypes)[id_col]
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = source.filter("id is not null and text is not null").mapInPandas(part, f"id {kind}, lang string, chars long, " + ", ".join(f"{f} double" for f in FEATURES))
    return rows


#: So many windows with the statistics of all stand beside a language's own: it outweighs them as it grows.
PRIOR = 200


def pooled(n: int, own: np.ndarray, every: np.ndarray) -> np.ndarray:
    """A language's statistic over its n windows, with PRIOR windows that have the statistic of all."""
    return (n * own + PRIOR * every) / (n + PRIOR)


def middle(value: Column) -> Column:
    """The exact median of values to four places, by counts of the different values, which are few."""
    return F.percentile(F.round(value, 4), F.lit(0.5))


def centres(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (median, inverse scatter); "" stands for all windows, and alone for those of no known language."""
    both = rows.filter(F.col("lang").isin(list(KNOWN))).unionAll(rows.withColumn("lang", F.lit("")))

    def by_windows(found: list[Row]) -> dict[str, np.ndarray]:
        own = {r["lang"]: np.array([r[f] for f in FEATURES]) for r in found}
        return {r["lang"]: pooled(r["n"], own[r["lang"]], own[""]) for r in found}

    centre = by_windows(both.groupBy("lang").agg(F.count("*").alias("n"), *(middle(F.col(f)).alias(f) for f in FEATURES)).collect())
    if not centre:
        return {}
    away = lambda f: F.abs(F.col(f) - by_language({k: v[FEATURES.index(f)] for k, v in centre.items()}))
    spread = by_windows(both.groupBy("lang").agg(F.count("*").alias("n"), *(middle(away(f)).alias(f) for f in FEATURES)).collect())
    scale = {lang: np.maximum(1.4826 * v, list(FLOOR.values())) for lang, v in spread.items()}
    # the scatter of the windows within three robust deviations in every feature
    near = both
    for k, f in enumerate(FEATURES):
        near = near.filter(away(f) <= 3 * by_language({lang: s[k] for lang, s in scale.items()}))
    moments = [F.avg(F.col(f) * F.col(g)).alias(f"{f}*{g}") for f in FEATURES for g in FEATURES] + [F.avg(f).alias(f) for f in FEATURES]
    # where no window is near in every feature, the centre and the scale themselves stand
    n, means = dict.fromkeys(centre, 0), dict(centre)
    squares = {lang: np.outer(m, m) + np.diag(scale[lang] ** 2) for lang, m in centre.items()}
    for r in near.groupBy("lang").agg(F.count("*").alias("n"), *moments).collect():
        n[r["lang"]], means[r["lang"]] = r["n"], np.array([r[f] for f in FEATURES])
        squares[r["lang"]] = np.array([[r[f"{f}*{g}"] for g in FEATURES] for f in FEATURES])
    out = {}
    for lang in centre:
        mean = pooled(n[lang], means[lang], means[""])
        cov = pooled(n[lang], squares[lang], squares[""]) - np.outer(mean, mean)
        cov += np.diag(np.array(list(FLOOR.values())) ** 2)
        out[lang] = (mean, np.linalg.inv(cov))
    return out


def by_language(values: dict[str, float]) -> Column:
    """The value of the row's language, else that of all."""
    out = F.lit(float(values[""]))
    for lang, v in values.items():
        if lang:
            out = F.when(F.col("lang") == lang, F.lit(float(v))).otherwise(out)
    return out


def along(direction: dict[str, tuple[float, float]], inverse: np.ndarray) -> np.ndarray:
    """What a deviation is multiplied with to give its distance along a direction: the whitened direction, of length 1."""
    scale = np.linalg.inv(inverse).diagonal() ** 0.5
    to = np.array([direction[f][0] if f in direction else 0.0 for f in FEATURES]) * scale
    return inverse @ to / (to @ inverse @ to) ** 0.5


def scored(rows: DataFrame) -> DataFrame:
    """rows with towards: the distance along the direction of spam that is farthest among those the window points in, or null."""
    stats = centres(rows)
    if not stats:
        return rows.withColumn("towards", F.lit(None).cast("double"))
    size, ways = range(len(FEATURES)), range(len(DIRECTIONS))
    values = []
    for lang, (mean, inverse) in stats.items():
        scale = np.linalg.inv(inverse).diagonal() ** 0.5
        values.append((lang, *map(float, mean), *map(float, scale), *(float(x) for d in DIRECTIONS for x in along(d, inverse))))
    names = ["_lang", *(f"_m{i}" for i in size), *(f"_s{i}" for i in size), *(f"_a{k}_{i}" for k in ways for i in size)]
    known = rows.sparkSession.createDataFrame(values, ", ".join(f"{n} {'string' if n == '_lang' else 'double'}" for n in names))
    of = F.when(F.col("lang").isin([k for k in stats if k]), F.col("lang")).otherwise("")
    away = rows.withColumn("_lang", of).join(F.broadcast(known), "_lang").withColumns({f"_d{i}": F.col(f) - F.col(f"_m{i}") for i, f in enumerate(FEATURES)})
    units = {f: F.col(f"_d{i}") / F.col(f"_s{i}") for i, f in enumerate(FEATURES)}

    def distance(k: int) -> Column:
        points = reduce(Column.__and__, (units[f] * math.copysign(1, part) >= least for f, (part, least) in DIRECTIONS[k].items()))
        return F.when(points & (units["marks"] < AWAY), reduce(Column.__add__, (F.col(f"_d{i}") * F.col(f"_a{k}_{i}") for i in size)))

    return away.select(*rows.columns, F.greatest(*map(distance, ways)).alias("towards"))


def spam_share(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cutoff: float = CUTOFF) -> DataFrame:
    """id, spam_share: the share of each text's characters that lies in windows flagged as spam."""
    rows = scored(checkpoint(measured(documents, id_col, text_col, lang_col)))
    flagged = F.col("towards") > cutoff
    return rows.groupBy("id").agg((F.sum(F.when(flagged, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share")).withColumnRenamed("id", id_col)
