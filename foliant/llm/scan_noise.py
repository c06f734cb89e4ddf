"""Problem 1: noise in text from scanned pages.

Skip-gram vectors of the frequent words are learned on the text of all pages. A word's place in their space is the mean
of the vectors around it: of all its occurrences for a known word (its profile), of its own occurrence for a rare one.
A word of a scanned page that no born-digital page has is linked to the frequent words that are its neighbours in this
space and that a plausible misreading turns into it: both are reduced to skeletons in which glyphs that are taken for
one another are the same, words whose skeletons are equal, or equal after one letter is dropped, meet, and the edit
between them must be cheap. Neighbours are words as near to their profile as all but MISFIT of the known words of
scanned pages are to theirs. Among the linked words the one with the best sum of edit cost, frequency and nearness is
taken. Running headers and page numbers are found at the page's edges, by form and by repetition in the document; words
broken at line ends are joined unless the hyphen belongs to the word.

Known are the words of born-digital pages, and of scanned pages those that occur SETTLED times and that no plausible
edit turns into a word ten times as frequent; so scans alone can be repaired too.

Only words that are not frequent leave their pages, as rows. To all tasks go the LEXICON most frequent words with their
profiles, and the vectors of the VOCABULARY most frequent words, all of bounded size. Where there are more known words,
those that a page asks for beyond the lexicon are joined with all of them, so that the lexicon's size changes no
result; words beyond the vocabulary have profiles like all others.

Cases: pages of other source types, null or blank content give no rows; a page with fewer blocks than lines, or none,
is judged by its text alone; repeated rows count once; a hyphen at a page's end counts as a broken word unless such
beginnings of compounds are known; a library too small for vectors has no misread words; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.lookalikes import BLANKS, HOMOGLYPHS, INVISIBLE, plain
from foliant.llm.words import mix
from foliant.runtime import checkpoint

#: The most frequent words, which go to all tasks (rarer ones are joined); how often a word must occur to be linked to.
LEXICON, FREQUENT = 100_000, 2
#: How often a word that only scanned pages have must occur to be known, and how much more often what it could be a misreading of.
SETTLED, RATIO = 20, 10
#: Skip-gram vectors: their length, the window, passes over the text, how often a word must occur to have one, words that have one at most.
VECTOR, REACH, PASSES, LEARNED, VOCABULARY = 16, 4, 1, 5, 100_000
#: Words that make up more than this share of all text are thinned out before learning, but never below so many occurrences.
THIN, KEPT = 3e-5, 200
#: Words of text that one task learns from, before the tasks' vectors are averaged.
LESSON = 200_000
#: Share of the known words of scanned pages that may lie farther from their profile than a neighbour.
MISFIT = 0.01
#: Lines at each edge of a page among which headers and page numbers are sought.
EDGE = 3
#: A misread copy of a header differs by at most this many letters, and by one in six.
EDITS = 6
#: Confidence of a line from which on its reading was sure.
SURE = 0.9
# Marks at which scanners see a hyphen at a line's end; marks that stand inside words only by misreading.
BREAKS, STRAY = "-¬=‐\u00ad", "~*^`|!¬=\\_{}<>#$"
# Groups of glyphs taken for one another, and pairs of glyphs taken for one.
ALIKE = ("1lI!|iíìjJ", "0oOaóQD", "5sS$", "6bhG", "ce(éèê", "9gqy", "ftT7", "nuüv", "zZ2", "8B", "rR")
PAIRS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("lc", "k"), ("li", "h"), ("nn", "m"), ("fi", "h"))
PAIRED = dict(PAIRS)
OUTER = ".,;:?()[]«»“”„\"…"
NUMBER = re.compile(r"^\W*(?:(?:page|seite|pages?|página|pagina|pág|p|s)\b\.?\s*)?(?:[\dlIO|]{1,5}|[ivxlc]{1,6})(?:\s*(?:/|of|von|de|sur|\|)\s*[\dlIO|]{1,5})?\W*$", re.I)
PLAIN_NUMBER = re.compile(r"^[+-]?\d[\d.,:/%-]*$")
FOLD = {c: group[-1].lower() for group in ALIKE for c in group}
#: Characters beyond the Latin and Greek blocks, among which are the styled and wide forms.
RARE = re.compile(f"[^{chr(0)}-{chr(0x3FF)}]")
UNUSUAL = re.compile(f"[{INVISIBLE}{BLANKS}{''.join(HOMOGLYPHS)}]|{RARE.pattern}")
DIGITS = re.compile(r"\d+")
_plain = str.maketrans({c: None for c in INVISIBLE} | {c: " " for c in BLANKS} | {ord(k): v for k, v in HOMOGLYPHS.items()})


def ordinary(text: str) -> str:
    """The text with look-alike characters in their ordinary form; the number of lines stays."""
    if text.isascii():
        return text
    if not UNUSUAL.search(text):
        return unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", RARE.sub(lambda m: plain(m[0]), text.translate(_plain)))


@lru_cache(maxsize=1 << 17)
def form_of(token: str) -> str:
    """The form of a token as it stands on a page."""
    return form(ordinary(token))


@lru_cache(maxsize=1 << 17)
def form(token: str) -> str:
    """How a word is counted: without outer punctuation, in lower case, digits of codes and amounts as 0."""
    word = token.strip(OUTER).lower()
    return word if word.isalpha() else DIGITS.sub("0", word)


def skeleton(word: str, pairs: bool = True) -> str:
    """The word with stray marks dropped and glyphs (with pairs: and pairs of glyphs) taken for one another made the same."""
    word = "".join(c for c in word.lower() if (c not in STRAY or c in FOLD) and c not in "'’-")
    for pair, one in PAIRS if pairs else ():
        word = word.replace(pair, one)
    return "".join(FOLD.get(c, c) for c in word)


def skeleton_keys(word: str) -> list[str]:
    """The skeletons with and without pairs, also without the marks that may be strokes, and each with one letter dropped."""
    bare = "".join(c for c in word if c not in STRAY)
    whole = {skeleton(w, pairs) for w in (word, bare) for pairs in (False, True)}
    return sorted(whole | {s[:k] + s[k + 1 :] for s in whole if len(s) >= 4 for k in range(len(s))})


def edit_cost(read: str, meant: str, most: float = 4.0) -> float:
    """Least cost of turning the meant word into the read one: 1 for a likely misreading or a stray mark, else 2."""
    a, b = read.lower(), meant.lower()
    n, m = len(a), len(b)
    if abs(n - m) > 3:
        return most + 1
    extra = [1.0 if c in STRAY or c == "'" else 2.0 for c in a]
    fold_a, fold_b = [FOLD.get(c, c) for c in a], [FOLD.get(c, c) for c in b]
    joined_a, joined_b = [PAIRED.get(a[i - 1 : i + 1]) for i in range(n)], [PAIRED.get(b[j - 1 : j + 1]) for j in range(m)]
    far = most + 1
    rows = [[j * 2.0 for j in range(m + 1)]]
    for i in range(1, n + 1):
        last, row = rows[-1], [far] * (m + 1)
        row[0] = last[0] + extra[i - 1]
        lo, hi = max(1, i - 4), min(m, i + 4)
        for j in range(lo, hi + 1):
            same = 0.0 if a[i - 1] == b[j - 1] else 1.0 if fold_a[i - 1] == fold_b[j - 1] else 2.0
            best = min(last[j - 1] + same, last[j] + extra[i - 1], row[j - 1] + 2.0)
            if i > 1 and joined_a[i - 1] == b[j - 1]:
                best = min(best, rows[i - 2][j - 1] + 1.0)
            if j > 1 and joined_b[j - 1] == a[i - 1]:
                best = min(best, last[j - 2] + 1.0)
            row[j] = best
        if min(row) > most:
            return far
        rows.append(row)
    return rows[n][m]


def allowed(read: str) -> float:
    """The cost up to which a link is plausible, by the length of what was read."""
    n = len("".join(c for c in read if c not in STRAY))
    return 1.0 if n <= 3 else 2.0 if n <= 6 else 3.0


def numbered(split: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts split into tokens: how many tokens each text has, the number of each token, the different tokens."""
    tokens = split.flatten().dictionary_encode()
    return pc.list_value_length(split).to_numpy(zero_copy_only=False), tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary.to_pylist()


def count_words(pages: DataFrame) -> DataFrame:
    """word, digital, scanned: how often each word occurs on born-digital and on scanned pages."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(counts: dict[bool, Counter]) -> pa.RecordBatch:
            folded: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for scanned, tokens in counts.items():
                for token, n in tokens.items():
                    folded[scanned][form(ordinary(token))] += n
            words = sorted(w for w in folded[False].keys() | folded[True].keys() if w)
            return pa.RecordBatch.from_pydict({"word": words, "digital": [folded[False][w] for w in words], "scanned": [folded[True][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("digital", pa.int64()), ("scanned", pa.int64())]))

        counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
        for batch in batches:
            size, number, tokens = numbered(pc.utf8_split_whitespace(batch.column(1)))
            of_scan = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            for scanned in (False, True):
                found = np.bincount(number[of_scan == scanned], minlength=len(tokens))
                there = found.nonzero()[0]
                counts[scanned].update(dict(zip((tokens[k] for k in there.tolist()), found[there].tolist(), strict=True)))
            if sum(map(len, counts.values())) > 1_000_000:  # memory stays bounded
                yield given(counts)
                counts = {False: Counter(), True: Counter()}
        yield given(counts)

    there = pages.filter("content is not null").select((F.coalesce("source_type", F.lit("")) == "ocr").alias("scanned"), "content")
    return there.mapInArrow(part, "word string, digital long, scanned long").groupBy("word").agg(F.sum("digital").alias("digital"), F.sum("scanned").alias("scanned"))


def edges(lines: list[str]) -> list[int]:
    """The numbers of the first and last EDGE lines that are not blank."""
    there = [k for k, x in enumerate(lines) if x.strip()]
    return sorted({*there[:EDGE], *there[-EDGE:]})


def title_key(line: str) -> str:
    """What is compared of a header: the skeleton of its letters, without numbers and the word page."""
    words = [w for w in re.findall(r"[^\W_]{2,}|[^\W\d_]", re.sub(r"\b(?:page|seite|página)\b", " ", line.lower())) if not w.isdigit()]
    return skeleton("".join(words))


def furniture(lines: list[str], heading: list[bool]) -> tuple[set[int], dict[int, bool]]:
    """Numbers of the lines that give the page number; lines that may be headers -> whether their form alone says so."""
    numbers, titles = set(), {}
    at_edge = edges(lines)
    there = [k for k, x in enumerate(lines) if x.strip()]
    running = sorted(len(x.strip()) for k, x in enumerate(lines) if k not in at_edge and not heading[k] and x.strip()) or [60]
    full = running[int(len(running) * 0.8)]
    for k in at_edge:
        text = lines[k].strip()
        outer = there.index(k) in (0, 1, len(there) - 1, len(there) - 2)
        if NUMBER.match(text) and outer and any(c.isalnum() for c in text):
            numbers.add(k)
        elif not heading[k] and len(re.findall(r"[^\W\d_]", text)) >= 8 and not text.endswith((".", ",", ";", *BREAKS)):
            after = next((lines[j].strip() for j in there if j > k), "")
            begins = not after or after[0].isupper() or not after[0].isalpha() or NUMBER.match(after)
            starts = text[0].isupper() or not text[0].isalpha()
            titles[k] = bool(starts and begins and (len(text) < 0.8 * full or " | " in text) and "»" not in text and outer)
    return numbers, titles


def read_pages(pages: DataFrame) -> DataFrame:
    """Scanned pages, each id once: page_id, document_id, content in ordinary form, heading and confidence of each line."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=batch["content"].map(ordinary))

    of = pages.filter("source_type = 'ocr' and id is not null").filter(F.col("content").rlike(r"(?U)\S"))
    rows = of.select(F.col("id").alias("page_id"), "document_id", "content", F.col("blocks.is_heading").alias("heading"), F.col("blocks.confidence").alias("confidence"))
    return rows.mapInPandas(part, "page_id string, document_id string, content string, heading array<boolean>, confidence array<double>").dropDuplicates(["page_id"])


def per_line(values: Iterable | None, lines: int, missing: object) -> list:
    got = [] if values is None else [missing if v is None else v for v in values]
    return (got + [missing] * lines)[:lines]


def most_edits(length: int) -> int:
    """How many letters of a header of this length may be misread."""
    return min(EDITS, length // 6)


def cut_points(length: int) -> list[tuple[int, int]]:
    """(start, size) of one piece more than a header of this length may have edits: a copy has one of them unchanged."""
    n = most_edits(length) + 1
    starts = [length * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]


def header_pieces(key: str) -> list[tuple[int, int, str]]:
    """(length, number of the piece, piece) of a repeated header."""
    return [(len(key), k, key[at : at + size]) for k, (at, size) in enumerate(cut_points(len(key)))]


def copy_pieces(key: str, lengths: Iterable[int]) -> set[tuple[int, int, str]]:
    """The pieces of headers of these lengths that a line could have as a copy: k edits at most stand before piece k."""
    out = set()
    for length in lengths:
        most, more = most_edits(length), len(key) - length
        if abs(more) > most:
            continue
        for k, (at, size) in enumerate(cut_points(length)):
            first, last = max(0, at - k, at + more - (most - k)), min(len(key) - size, at + k, at + more + (most - k))
            out.update((length, k, key[x : x + size]) for x in range(first, last + 1))
    return out


def header_copies(single: DataFrame, models: DataFrame) -> DataFrame:
    """document_id, key of the single lines that are misread copies of any header repeated in their document.

    Lines and headers meet in a piece that the edits leave unchanged; only lengths that a document's headers have are tried.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, m, *x) for d, m in batch.itertuples(index=False, name=None) for x in header_pieces(m)]
            yield pd.DataFrame(rows, columns=["document_id", "model", "length", "number", "piece"])

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, key, *x) for d, key, lengths in batch.itertuples(index=False, name=None) for x in copy_pieces(key, lengths)]
            yield pd.DataFrame(rows, columns=["document_id", "key", "length", "number", "piece"])

    lengths = models.groupBy("document_id").agg(F.collect_set(F.length("model")).alias("lengths"))
    lines = single.select("document_id", "key").distinct().join(lengths, "document_id")
    lines = lines.mapInPandas(tried, "document_id string, key string, length int, number int, piece string")
    headers = models.select("document_id", "model").mapInPandas(pieces, "document_id string, model string, length int, number int, piece string")
    near = F.levenshtein("key", "model", EDITS)
    met = lines.join(headers, ["document_id", "length", "number", "piece"]).filter((near >= 0) & (near * 6 <= F.length("model")))
    return met.select("document_id", "key").distinct()


def header_lines(scanned: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, line_no, defect (header, number) of the page furniture."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, document, content, heading in zip(batch["page_id"], batch["document_id"], batch["content"], batch["heading"], strict=True):
                lines = content.split("\n")
                numbers, titles = furniture(lines, per_line(heading, len(lines), False))
                rows += [(page, document, k, "", True, True) for k in numbers]
                rows += [(page, document, k, title_key(lines[k]), strong, False) for k, strong in titles.items()]
            yield pd.DataFrame(rows, columns=["page_id", "document_id", "line_no", "key", "strong", "number"])

    found = checkpoint(scanned.mapInPandas(part, "page_id string, document_id string, line_no int, key string, strong boolean, number boolean"))
    titles = found.filter("not number")

    # a line that other documents have too, outside of headings, belongs to the site and not to the page
    def site(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for document, content, heading in zip(batch["document_id"], batch["content"], batch["heading"], strict=True):
                lines = content.split("\n")
                for text, is_heading in zip(lines, per_line(heading, len(lines), False), strict=True):
                    if not is_heading and not text.rstrip().endswith((".", *BREAKS)) and len(text.strip()) > 12:
                        rows.add((title_key(ordinary(text)), document))
            yield pd.DataFrame(sorted(rows, key=str), columns=["key", "document_id"])

    digital = pages.filter("source_type = 'text' and content is not null").select("document_id", "content", F.col("blocks.is_heading").alias("heading"))
    elsewhere = digital.mapInPandas(site, "key string, document_id string").join(titles.select("key").distinct(), "key", "left_semi")
    shared = elsewhere.groupBy("key").agg(F.countDistinct("document_id").alias("n")).filter("n >= 2").select("key")
    own = checkpoint(titles.join(shared, "key", "left_anti"))
    repeated = checkpoint(own.groupBy("document_id", "key").agg(F.countDistinct("page_id").alias("n")))
    # misread copies of any line that the document repeats
    single = own.filter("not strong").join(repeated.filter("n = 1"), ["document_id", "key"])
    copies = header_copies(single, repeated.filter("n >= 2").select("document_id", F.col("key").alias("model")))
    like = single.join(copies, ["document_id", "key"]).select("page_id", "line_no")
    headers = own.join(repeated, ["document_id", "key"]).filter("strong or n >= 2").select("page_id", "line_no").unionAll(like).distinct().select("page_id", "line_no", F.lit("header").alias("defect"))
    return headers.unionAll(found.filter("number").select("page_id", "line_no", F.lit("number").alias("defect")))


class Certain(dict):
    """token -> whether it is known whatever a page has beyond the frequent words: blank, a number, or frequent."""

    def __init__(self, frequent: dict[str, int]):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:  # memory stays bounded
            self.clear()
        f = form(token)
        self[token] = known = not f or f in self.frequent or bool(PLAIN_NUMBER.match(f))
        return known


class Reader:
    """Finds broken and odd words in a page's lines, given the frequent words and, in rare, those of a page beyond them.

    What was asked for and is not among the frequent words stands in asked, whatever the answers were: words, and first
    parts of compounds with BEGINS behind them.
    """

    BEGINS = " -"

    def __init__(self, frequent: dict[str, int]):
        self.known = frequent
        self.certain = Certain(frequent)
        self.rare: dict[str, int] = {}
        self.asked: set[str] = set()
        self.first_parts = Counter()
        for w, n in frequent.items():
            if "-" in w[1:-1]:
                self.first_parts[w.split("-")[0]] += n

    def count(self, word: str) -> int:
        if word in self.known:
            return self.known[word]
        self.asked.add(word)
        return self.rare.get(word, 0)

    def count_first(self, part: str) -> int:
        """How often compounds with this first part occur; the lexicon has only some of them."""
        self.asked.add(part + self.BEGINS)
        return self.rare.get(part + self.BEGINS, self.first_parts.get(part, 0))

    def is_known(self, token: str) -> bool:
        return self.certain[token] or self.count(form(token)) > 0

    def read(self, lines: list[list[str]]) -> tuple[list[tuple], list[tuple]]:
        """(line, hyphen token, next line) of broken words; (line, place, token, next line, length of the first part) of odd words.

        Given are the tokens of a page's lines.
        """
        broken, odd, continued = [], [], set()
        there = [k for k, x in enumerate(lines) if x]
        for n, k in enumerate(there):
            end = lines[k][-1]
            if end[-1] not in BREAKS or len(end) < 2 or not end[-2].isalpha():
                continue
            start = end[:-1].lstrip(OUTER)
            after = next((j for j in there[n + 1 :] if lines[j][0][0].islower() or not lines[j][0][0].isalnum() and lines[j][0][-1:].isalpha()), None)
            rest = lines[after][0].rstrip(OUTER) if after is not None else ""
            whole, compound = form(start + rest), form(f"{start}-{rest}")
            together, apart, first = self.count(whole), self.count(compound), self.count_first(form(start))
            begun, ended = self.count(form(start)), self.count(form(rest))
            if not together and not apart and rest:
                apart = first * (ended > 0 or not begun)
                together = 0 if apart else 1
            elif not rest:
                together, apart = 1, first
            if together >= apart:
                broken.append((k, start, after))
            if after is not None:
                continued.add((k, len(lines[k]) - 1))
                continued.add((after, 0))
                token = start + rest if together >= apart else f"{start}-{rest}"
                if not self.is_known(token):
                    odd.append((k, len(lines[k]) - 1, token, after, len(start)))
            else:
                continued.add((k, len(lines[k]) - 1))
        certain = self.certain
        for n, k in enumerate(there):
            for place, token in enumerate(lines[k]):
                if certain[token] or (k, place) in continued or self.is_known(token):
                    continue
                if n == 0 and place == 0 and token[0].islower() and not any(c in STRAY for c in token):
                    continue  # may continue a word of the page before
                odd.append((k, place, token, None, 0))
        return broken, odd


def linked(tokens: DataFrame, meant: DataFrame) -> DataFrame:
    """token, meant, cost: the words that a plausible misreading turns into a token; they meet in a skeleton. Both: word."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, key) for w in batch["word"] for key in skeleton_keys(w.strip(OUTER))], columns=["word", "key"])

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            costs = [edit_cost(t.strip(OUTER), m) for t, m in zip(batch["token"], batch["meant"], strict=True)]
            kept = [c <= allowed(t) for c, t in zip(costs, batch["token"], strict=True)]
            yield batch.assign(cost=costs)[kept]

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work on each row
    own = tokens.select("word").distinct().mapInPandas(keys, "word string, key string").select(F.col("word").alias("token"), "key")
    of = meant.select("word").filter(F.length("word") > 1).mapInPandas(keys, "word string, key string").select(F.col("word").alias("meant"), "key")
    pairs = own.join(of, "key").select("token", "meant").distinct().repartition(parts)
    return pairs.mapInPandas(cost, "token string, meant string, cost double")


def known_words(counted: DataFrame) -> DataFrame:
    """word, n: how often each known word occurs: on born-digital pages, or a settled one on scanned pages."""
    n = F.col("digital") + F.col("scanned")
    often = checkpoint(counted.filter((F.col("digital") == 0) & (F.col("scanned") >= SETTLED)))
    more = counted.filter(n >= SETTLED * RATIO)
    links = linked(often, more).join(often.select(F.col("word").alias("token"), "scanned"), "token").join(more.select(F.col("word").alias("meant"), n.alias("n")), "meant")
    misread = links.filter(F.col("n") >= RATIO * F.col("scanned")).select(F.col("token").alias("word")).distinct()
    settled = often.join(misread, "word", "left_anti").select("word", F.col("scanned").alias("n"))
    return counted.filter("digital >= 1").select("word", F.col("digital").alias("n")).unionAll(settled)


def frequent_words(words: DataFrame, places: DataFrame) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """The LEXICON most frequent known words, with their counts and, as far as they have one, their profiles."""
    top = words.orderBy(F.desc("n"), "word").limit(LEXICON).join(places, "word", "left").collect()
    return {r["word"]: r["n"] for r in top}, {r["word"]: np.array(r["profile"], np.float32) for r in top if r["profile"] is not None}


def shares(counted: DataFrame, total: int) -> dict[str, float]:
    """The words that are thinned out -> the share of their occurrences that is kept; at most 1 / THIN words."""
    n = F.col("digital") + F.col("scanned")
    common = {r["word"]: r["n"] for r in counted.select("word", n.alias("n")).filter((F.col("n") > THIN * total) & (F.col("n") > KEPT)).collect()}
    return {w: max((THIN * total / n) ** 0.5, KEPT / n) for w, n in common.items()}


def chances(texts: list[str], size: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each token of each text, as by chance, but always the same for a text."""
    seeds = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
    place = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
    return (mix(np.repeat(seeds, size) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53


def sentences(pages: DataFrame, share: dict[str, float]) -> DataFrame:
    """text: the words of each page, as they are counted, with blanks between; words that are everywhere are thinned out."""
    thin = pages.sparkSession.sparkContext.broadcast(share)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = thin.value
        for batch in batches:
            size, number, tokens = numbered(pc.utf8_split_whitespace(batch.column(0)))
            forms = [form_of(t) for t in tokens]
            part_kept = np.array([share.get(f, 1.0) if f else 0.0 for f in forms])
            kept = chances(batch.column(0).to_pylist(), size) < part_kept[number]
            text = np.repeat(np.arange(len(size)), size)[kept]
            ends = np.concatenate([[0], np.bincount(text, minlength=len(size)).cumsum()])
            taken = pa.array(forms, pa.string()).take(pa.array(number[kept]))
            yield pa.RecordBatch.from_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), " ")], names=["text"])

    return pages.select("content").filter(F.col("content").rlike(r"(?U)\S")).mapInArrow(part, "text string")


def sizes(counted: DataFrame) -> tuple[int, int]:
    """How many words of text there are, and how many different ones that occur LEARNED times."""
    n = F.col("digital") + F.col("scanned")
    got = counted.agg(F.sum(n).alias("words"), F.count_if(n >= LEARNED).alias("learned")).first()
    return got["words"] or 0, got["learned"]


def vectors(texts: DataFrame, counted: DataFrame, total: int, different: int) -> dict[str, np.ndarray]:
    """Skip-gram vectors of the VOCABULARY most frequent words, learned on all texts; of length 1, their common part taken off."""
    least = LEARNED
    if different > VOCABULARY:
        least = counted.select((F.col("digital") + F.col("scanned")).alias("n")).orderBy(F.desc("n")).offset(VOCABULARY).limit(1).first()["n"] + 1
    tasks = max(1, min(texts.rdd.getNumPartitions(), -(-total // LESSON)))
    learner = Word2Vec(vectorSize=VECTOR, windowSize=REACH, minCount=least, maxIter=PASSES, numPartitions=tasks, seed=1, inputCol="words", outputCol="vector")
    try:
        model = learner.fit(texts.select(F.split("text", " ").alias("words")))
    except Exception as error:  # too little text for a single word to be learned
        if "vocabulary size should be > 0" in str(error):
            return {}
        raise
    learned = model.getVectors().collect()
    space = unit(np.array([r["vector"].toArray() for r in learned], np.float32))
    return dict(zip((r["word"] for r in learned), unit(space - space.mean(axis=0)), strict=True))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay zeros."""
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class Space:
    """Where the words of texts stand: the mean of the vectors around each."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.at = {w: k for k, w in enumerate(learned)}
        self.rows = np.vstack([*learned.values(), np.zeros((1, VECTOR), np.float32)]) if learned else np.zeros((1, VECTOR), np.float32)

    def around(self, size: np.ndarray, number: np.ndarray, words: list[str]) -> np.ndarray:
        """For each word of each text the direction of the words within REACH; zeros if none of them has a vector.

        Given are the texts' sizes, the number of each of their words, and the words.
        """
        if not len(number):
            return np.zeros((0, VECTOR), np.float32)
        none = len(self.rows) - 1
        code = np.array([self.at.get(f, none) for f in words])
        k = np.arange(len(number)) + REACH * np.repeat(np.arange(1, len(size) + 1), size)
        codes = np.full(len(number) + REACH * (len(size) + 1), none)
        codes[k] = code[number]
        vectors = self.rows[codes]
        before = np.vstack([np.zeros((1, VECTOR)), vectors.cumsum(axis=0, dtype=np.float64)])
        return unit((before[k + REACH + 1] - before[k - REACH] - vectors[k]).astype(np.float32))


def profiles(texts: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """word, profile: the mean place of each word over all texts, of length 1."""
    names = [f"v{k}" for k in range(VECTOR)]
    by = texts.sparkSession.sparkContext.broadcast(learned)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, number, sums = Space(by.value), {}, np.zeros((1024, VECTOR))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": list(number), **{c: sums[: len(number), k] for k, c in enumerate(names)}})

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                size, own, forms = numbered(pc.split_pattern(batch.column(0).slice(at, 2000), " "))
                place = np.array([number.setdefault(f, len(number)) for f in forms])
                if len(number) > len(sums):
                    sums = np.vstack([sums, np.zeros((max(len(sums), len(number) - len(sums)), VECTOR))])
                there = space.around(size, own, forms)
                for k in range(VECTOR):
                    sums[place, k] += np.bincount(own, there[:, k], len(forms))
            if len(number) > 200_000:  # memory stays bounded
                yield given()
                number, sums = {}, np.zeros((1024, VECTOR))
        if number:
            yield given()

    summed = texts.select("text").mapInArrow(part, "word string, " + ", ".join(f"{c} double" for c in names)).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    return summed.withColumn("_l", length).filter("word != '' and _l > 0").select("word", F.array(*((F.col(c) / F.col("_l")).cast("float") for c in names)).alias("profile"))


def tokens_of_lines(content: str, skip: set[int]) -> list[list[str]]:
    """The tokens of each line of a page; none of the lines to skip."""
    return [[] if k in skip else x.split() for k, x in enumerate(content.split("\n"))]


def with_rare(there: DataFrame, words: DataFrame, shared: Broadcast) -> DataFrame:
    """there with rare: how often known words are what a page asks for beyond the lexicon (null: the lexicon is all)."""
    if len(shared.value) < LEXICON:
        return there.withColumn("rare", F.lit(None).cast("array<struct<key string, n long>>"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = []
            for page, content, skip in zip(batch["page_id"], batch["content"], batch["gone"], strict=True):
                reader.asked = set()
                reader.read(tokens_of_lines(content, set() if skip is None else set(skip)))
                rows += [(page, key) for key in sorted(reader.asked)]
            yield pd.DataFrame(rows, columns=["page_id", "key"])

    known = words.select(F.col("word").alias("key"), "n")
    compounds = known.filter("instr(substring(key, 2, length(key) - 2), '-') > 0")
    firsts = compounds.groupBy(F.concat(F.substring_index("key", "-", 1), F.lit(Reader.BEGINS)).alias("key")).agg(F.sum("n").alias("n"))
    asked = there.select("page_id", "content", "gone").mapInPandas(part, "page_id string, key string")
    rare = asked.join(known.unionAll(firsts), "key").groupBy("page_id").agg(F.collect_list(F.struct("key", "n")).alias("rare"))
    return there.join(rare, "page_id", "left")


#: Steps of the nearness of known words to their profiles in which it is counted.
STEPS = 400


def odd_words(scanned: DataFrame, gone: DataFrame, frequent: dict[str, int], words: DataFrame, learned: dict[str, np.ndarray], near: dict[str, np.ndarray]) -> DataFrame:
    """Rows of broken words (kind hyphen) and odd words (kind word) of the pages' lines other than furniture.

    Also (kind fit) how many known words of a page are how near to their profile: line_no is the step, place the number.
    Words that were thinned out before learning have their vectors shortened to the share that was kept.
    """
    context = scanned.sparkSession.sparkContext
    shared, places, around_by = context.broadcast(frequent), context.broadcast(near), context.broadcast(learned)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, space, place_of = Reader(shared.value), Space(around_by.value), places.value
        known = {w: k for k, w in enumerate(place_of)}
        profile = np.vstack(list(place_of.values())) if place_of else np.zeros((0, VECTOR), np.float32)
        for batch in (b.iloc[at : at + 500] for b in batches for at in range(0, len(b), 500)):
            rows, fits = [], np.zeros(STEPS + 1, np.int64)
            gone = [set() if skip is None else set(skip) for skip in batch["gone"]]
            split = [tokens_of_lines(content, skip) for content, skip in zip(batch["content"], gone, strict=True)]
            tokens = pa.array([t for lines in split for x in lines for t in x], pa.string()).dictionary_encode()
            number, forms = tokens.indices.to_numpy(zero_copy_only=False), [form(t) for t in tokens.dictionary.to_pylist()]
            around = space.around(np.array([sum(map(len, lines)) for lines in split]), number, forms)
            of = np.array([known.get(f, -1) for f in forms], np.int64)[number]
            at = np.flatnonzero(of >= 0)
            of = of[at]
            nearness = np.einsum("ij,ij->i", around[at], profile[of])[around[at].any(axis=1)]
            fits += np.bincount(((nearness.clip(-1, 1) + 1) * STEPS / 2).astype(int), minlength=STEPS + 1)
            first = 0
            for page, confidence, rare, lines in zip(batch["page_id"], batch["confidence"], batch["rare"], split, strict=True):
                reader.rare, reader.asked = {} if rare is None else {r["key"]: r["n"] for r in rare}, set()
                broken, odd = reader.read(lines)
                starts = np.cumsum([first, *map(len, lines)])
                first = starts[-1]
                sure = per_line(confidence, len(lines), 1.0)
                rows += [(page, "hyphen", k, 0, start, after, 0, None, 1.0) for k, start, after in broken]
                rows += [(page, "word", k, place, token, after, cut, around[starts[k] + place], sure[k] if after is None else min(sure[k], sure[after])) for k, place, token, after, cut in odd]
            rows += [(None, "fit", int(k), int(fits[k]), None, None, 0, None, 1.0) for k in fits.nonzero()[0]]
            out = pd.DataFrame(rows, columns=["page_id", "kind", "line_no", "place", "token", "next_line", "cut", "around", "confidence"])
            yield out.astype({"next_line": "Int64"})

    without = gone.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    there = with_rare(scanned.join(without, "page_id", "left"), words, shared)
    return there.mapInPandas(part, "page_id string, kind string, line_no int, place int, token string, next_line int, cut int, around array<float>, confidence double")


def least_fit(odd: DataFrame) -> float:
    """The nearness to their profiles that all but MISFIT of the known words of scanned pages reach; beyond any if none is near one."""
    counts = {r["line_no"]: r["n"] for r in odd.filter("kind = 'fit'").groupBy("line_no").agg(F.sum("place").alias("n")).collect()}
    total, below = sum(counts.values()), 0
    for step in sorted(counts):
        below += counts[step]
        if below > MISFIT * total:
            return 2 * step / STEPS - 1
    return 2.0


def corrections(odd: DataFrame, words: DataFrame, places: DataFrame) -> DataFrame:
    """The odd words that are misread, each with the word that was meant: the best of its neighbours by plausible edits."""
    least = least_fit(odd)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                fit = np.einsum("ij,ij->i", np.stack(batch["around"].to_numpy()), np.stack(batch["profile"].to_numpy()))
                scored = batch.assign(score=-2.0 * batch["cost"] + np.log(batch["n"]) * 0.5 + fit)[fit >= least]
                yield scored[["page_id", "line_no", "place", "token", "meant", "cost", "score"]]

    frequent = words.filter(F.col("n") >= FREQUENT)
    links = linked(odd.filter("kind = 'word'").select(F.col("token").alias("word")), frequent)
    known = frequent.join(places, "word").select(F.col("word").alias("meant"), "n", "profile")
    links = checkpoint(links.join(known, "meant"))
    at = ["page_id", "line_no", "place"]
    met = odd.filter("kind = 'word'").join(links, "token").select(*at, "token", "around", "meant", "n", "cost", "profile")
    scored = met.mapInPandas(score, "page_id string, line_no int, place int, token string, meant string, cost double, score double")
    best = scored.groupBy(*at).agg(F.max_by(F.struct("meant", "cost"), F.struct("score", "meant")).alias("best"))
    # an edit that no glyphs explain counts only where the reading of the line was unsure
    plausible = (F.col("best.cost") < 2) | (F.col("confidence") < SURE)
    return odd.filter("kind = 'word'").drop("around").join(best, at).filter(plausible).withColumn("meant", F.col("best.meant")).drop("best")


def defects(pages: DataFrame) -> DataFrame:
    """page_id, line_no, defect (hyphen, char, header, number) of scanned pages."""
    parts = analysed(pages)
    broken, wrong = parts["odd"].filter("kind = 'hyphen'"), parts["wrong"]
    first = F.substring("token", F.lit(1), F.col("cut"))
    # of a word on two lines the error is where the meant word differs
    head = F.col("next_line").isNull() | (F.lower(first) != F.substring("meant", F.lit(1), F.col("cut")))
    tail = F.col("next_line").isNotNull() & ~F.expr("endswith(meant, lower(substring(token, cut + 1)))")
    chars = wrong.select("page_id", F.explode(F.array_compact(F.array(F.when(head, F.col("line_no")), F.when(tail, F.col("next_line"))))).alias("line_no"))
    rows = parts["furniture"].unionAll(broken.select("page_id", "line_no", F.lit("hyphen").alias("defect"))).unionAll(chars.select("page_id", "line_no", F.lit("char").alias("defect")))
    return rows.distinct()


def analysed(pages: DataFrame) -> dict[str, DataFrame]:
    """The parts of the analysis: scanned pages, furniture, broken and odd words, misread words."""
    counted = checkpoint(count_words(pages))
    words = checkpoint(known_words(counted))
    total, different = sizes(counted)
    share = shares(counted, total)
    texts = checkpoint(sentences(pages, share))
    learned = vectors(texts, counted, total, different)
    places = checkpoint(profiles(texts, learned))
    frequent, near = frequent_words(words, places)
    scanned = checkpoint(read_pages(pages))
    gone = checkpoint(header_lines(scanned, pages))
    odd = checkpoint(odd_words(scanned, gone, frequent, words, {w: v * share.get(w, 1.0) for w, v in learned.items()}, near))
    return {"scanned": scanned, "furniture": gone, "odd": odd, "wrong": corrections(odd, words, places)}


def repaired(pages: DataFrame) -> DataFrame:
    """page_id, text: scanned pages as paragraphs, with broken words whole, misread words right and furniture gone."""
    parts = analysed(pages)
    fixes = parts["wrong"].groupBy("page_id").agg(F.collect_list(F.struct("line_no", "place", "token", "next_line", "meant")).alias("fixes"))
    joins = parts["odd"].filter("kind = 'hyphen'").groupBy("page_id").agg(F.collect_list(F.struct("line_no", "next_line")).alias("joins"))
    gone = parts["furniture"].groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [reflowed(c, h, g, j, f) for c, h, g, j, f in zip(batch["content"], batch["heading"], batch["gone"], batch["joins"], batch["fixes"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "text": texts})

    there = parts["scanned"].join(gone, "page_id", "left").join(joins, "page_id", "left").join(fixes, "page_id", "left")
    return there.select("page_id", "content", "heading", "gone", "joins", "fixes").mapInPandas(part, "page_id string, text string")


def reflowed(content: str, heading: Iterable | None, gone: Iterable | None, joins: Iterable | None, fixes: Iterable | None) -> str:
    """One page's lines as paragraphs: a paragraph ends with a sentence on a line that leaves room, and around headings."""
    lines = [x.split() for x in content.split("\n")]
    is_heading = per_line(heading, len(lines), False)
    for k in gone if gone is not None else ():
        lines[k] = []
    full = max((len(" ".join(x)) for x in lines), default=0)
    short = [len(" ".join(x)) < 0.85 * full for x in lines]
    moved = {}
    for f in fixes if fixes is not None else ():
        word = f["token"].strip(OUTER)
        to = f["meant"].upper() if word.isupper() and len(word) > 2 else f["meant"].capitalize() if word[:1].isupper() else f["meant"]
        if f["next_line"] is None or pd.isna(f["next_line"]):
            lines[f["line_no"]][f["place"]] = lines[f["line_no"]][f["place"]].replace(word, to)
        else:
            moved[f["line_no"]] = to
    for j in joins if joins is not None else ():
        k, after = j["line_no"], j["next_line"]
        if after is None or pd.isna(after) or not lines[after] or not lines[k]:
            continue
        rest = lines[after].pop(0)
        tail = rest[len(rest.rstrip(OUTER)) :]
        start = lines[k][-1][:-1]
        lead = start[: len(start) - len(start.lstrip(OUTER))]
        lines[k][-1] = lead + moved.pop(k) + tail if k in moved else start + rest
    for k, to in moved.items():  # a compound at the line's end
        left, _, right = to.partition("-")
        lines[k][-1] = left + "-"
    paragraphs: list[str] = []
    fresh = True
    for k, x in enumerate(lines):
        text = " ".join(x)
        if not text:
            continue
        if fresh or is_heading[k]:
            paragraphs.append(text)
        elif paragraphs[-1].endswith("-"):
            paragraphs[-1] += text
        else:
            paragraphs[-1] += " " + text
        fresh = bool(is_heading[k] or short[k] and text.endswith((".", "!", "?", ":")))
    return "\n\n".join(paragraphs)
