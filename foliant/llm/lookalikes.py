"""Problem 2: one form for text that looks the same.

Units are code points and composable sequences (a letter with combining marks). Units drawn alike are joined, over
any number of steps, by union-find; a class is represented by its most frequent unit in the corpus, for each script of
its letters apart; a multi-pattern automaton rewrites the text greedily from the left, longest match first.

A letter is rewritten within its own script, and into another only in a word of letters of several scripts: there into
the script of the letters that no other script has, else into that of most letters, else into the corpus's own. So no
letter of a word's own script ever changes its script, whatever script the corpus has most of.

Both passes are narrow (no shuffle of text). What reaches the driver is the census of distinct units, bounded by
Unicode itself: single code points, and sequences only where a precomposed form exists.

Cases: null text stays null and is never a case; empty text stays empty; repeated rows give repeated rows (queries
on ids de-duplicate); columns of the input other than the text pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Letters of other scripts drawn like a Latin letter.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіѕјһԁԛԝАВЕЅІЈКМНОРСТХҮοΑΒΕΖΗΙΚΜΝΟΡΤΥΧνօսհո",
        "aeopcyxisjhdqwABESIJKMHOPCTXYoABEZHIKMNOPTYXvouhn",
        strict=True,
    )
)
# Characters that take no room.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF)))
# Blanks other than the ordinary one.
BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
MARKS = f"{chr(0x300)}-{chr(0x36F)}"
MARKED = re.compile(rf"[^\W_][{MARKS}]+")
#: A word with the marks and invisible characters inside it.
EXTENT = re.compile(rf"[\w{MARKS}{INVISIBLE}]+")
PIECE = 1 << 20
#: What the joined letters stand for.
JOINED = sorted({unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)})


def count_units(texts: Iterable[str]) -> Counter:
    """How often each code point and each composable marked letter occurs."""
    counts = np.zeros(0x110000, np.int64)
    marked, joint = Counter(), Counter()
    held: list[str] = []
    size = 0

    def flush() -> None:
        joined = "".join(held)
        codes, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        counts[codes] += n
        joint.update({pair: joined.count(pair) for pair in JOINED})
        if codes.size and ((codes >= 0x300) & (codes <= 0x36F)).any():
            for text in held:
                marked.update(m for m in MARKED.findall(text) if composed(m))

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            flush()
            held, size = [], 0
    flush()
    return marked + joint + Counter({chr(c): int(counts[c]) for c in counts.nonzero()[0]})


def composed(sequence: str) -> str | None:
    """The one code point, after folding of compatibility letters, that a marked letter is drawn like."""
    whole = unicodedata.normalize("NFC", plain(sequence[0]) + sequence[1:])
    return whole if len(whole) == 1 else None


def plain(char: str) -> str:
    """The ordinary letters that a wide, narrow, styled or joined form stands for; else the character."""
    kind = unicodedata.decomposition(char).partition(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= ord(char) <= 0xFB06:
        return unicodedata.normalize("NFKC", char)
    return char


def partners(unit: str) -> list[str]:
    """The units that a unit is drawn like, one step away."""
    if len(unit) > 1:
        return [unicodedata.normalize("NFC", unit), composed(unit) or unit]
    if unit in INVISIBLE:
        return [""]
    if unit in BLANKS:
        return [" "]
    return [plain(unit), HOMOGLYPHS.get(unit, unit), unicodedata.normalize("NFC", unit)]


#: Letters that have a look-alike in another script.
AMBIGUOUS = frozenset(HOMOGLYPHS) | frozenset(HOMOGLYPHS.values())


@cache
def script(unit: str) -> str:
    """The script of a letter, in its ordinary form; nothing for what is no letter."""
    char = unicodedata.normalize("NFC", plain(unit[0]))[0] if unit else ""
    return unicodedata.name(char, "").partition(" ")[0] if char.isalpha() else ""


class Forms(dict):
    """Each unit that must change within its script -> its class's most frequent unit of that script (ties: the least code point).

    across: each letter that other scripts have too -> script -> the class's most frequent letter of it. usual: the
    script that the corpus has most of; foreign: the letters of other scripts that share letters. The class of invisible characters is represented by the empty string, which
    stands between any two characters.
    """

    across: dict[str, dict[str, str]]
    usual: str
    foreign: frozenset[str]


def representatives(census: dict[str, int]) -> Forms:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    todo = list(census)
    while todo:
        x = todo.pop()
        for y in partners(x):
            if y != x and root(x) != root(y):
                parent[root(x)] = root(y)
                todo.append(y)
    best: dict[str, dict[str, str]] = {}
    rank = lambda u: (u != "", -census.get(u, 0), len(u), u)
    for unit in parent:
        own = best.setdefault(root(unit), {})
        own[script(unit)] = min(own.get(script(unit), unit), unit, key=rank)
    forms = Forms((u, to) for u in parent if u and (to := best[root(u)][script(u)]) != u)
    forms.across = {u: best[root(u)] for u in parent if u in AMBIGUOUS and len(best[root(u)]) > 1}
    counts = Counter()
    for unit, n in census.items():
        counts[script(unit)] += n
    del counts[""]
    forms.usual = max(sorted(counts), key=lambda k: counts[k], default="LATIN")
    sharing = {script(u) for u in forms.across} - {forms.usual}
    forms.foreign = frozenset(u for u in census if len(u) == 1 and script(u) in sharing and plain(u) == u)
    return forms


def census(texts: DataFrame, column: str) -> dict[str, int]:
    """Unit counts over all rows; at most as many entries as Unicode has units."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = count_units(t for b in batches for t in b.column(0).to_pylist() if t)
        if got:
            yield pa.RecordBatch.from_pydict({"unit": list(got), "n": list(got.values())}, schema=pa.schema([("unit", pa.string()), ("n", pa.int64())]))

    rows = texts.select(column).mapInArrow(part, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return {r["unit"]: r["n"] for r in rows.toLocalIterator()}


class Rewriter:
    """Rewrites texts by an automaton over the units that must change, and the letters of other scripts than the usual."""

    def __init__(self, forms: Forms):
        self.forms = forms
        self.foreign = forms.foreign
        self.machine = ahocorasick.Automaton()
        for unit in forms.keys() | self.foreign:
            self.machine.add_word(unit, unit)
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()
        self.any_foreign = re.compile(f"[{''.join(map(re.escape, sorted(self.foreign)))}]") if self.foreign else None

    def units(self) -> set[str]:
        """The units whose last character a text must have to change at all."""
        return self.forms.keys() | self.foreign

    def __call__(self, text: str) -> str:
        if self.empty:
            return text
        mixed = bool(self.any_foreign and self.any_foreign.search(text))
        out, at, word = [], 0, None
        for end, unit in self.machine.iter_long(text):
            start = end + 1 - len(unit)
            if start < at:
                continue
            if mixed or unit in INVISIBLE:
                if word is None or not word.start() <= start < word.end():
                    word = EXTENT.search(text, self._left(text, start))
                inside = word is not None and word.start() <= start < word.end()
                if inside and mixed and (to := self.word_script(word.group())):
                    out += [text[at : word.start()], self.brought(word.group(), to)]
                    at = word.end()
                    continue
                if unit in INVISIBLE and inside and not self._droppable(word.group()):
                    continue
            if unit in self.forms:
                out += [text[at:start], self.forms[unit]]
                at = end + 1
        return "".join(out) + text[at:] if out else text

    def word_script(self, word: str) -> str | None:
        """The script that a word of letters of several scripts belongs to; none if it has but one."""
        letters = [plain(c)[0] for c in word if c.isalpha() and c not in INVISIBLE]
        every = Counter(map(script, letters))
        if len(every) < 2:
            return None
        sure = Counter(script(c) for c in letters if c not in AMBIGUOUS) or every
        most = max(sure.values())
        tied = sorted(k for k, n in sure.items() if n == most)
        return self.forms.usual if self.forms.usual in tied else tied[0]

    def brought(self, word: str, to: str) -> str:
        """The word with its letters in one script, as far as they have a form there, and in the ordinary form."""
        letters = (self.forms.get(c, c) for c in word)
        joined = unicodedata.normalize("NFC", "".join(letters))
        return "".join(self.forms.across.get(c, {}).get(to, c) for c in joined)

    @staticmethod
    def _left(text: str, at: int) -> int:
        while at > 0 and EXTENT.fullmatch(text[at - 1]):
            at -= 1
        return at

    @staticmethod
    def _droppable(word: str) -> bool:
        """Whether invisible characters go from a word: joiners belong to the spelling of scripts that need them, so they
        stay in a word of letters that are neither Latin, Greek nor Cyrillic."""
        letters = [c for c in word if c.isalpha() and c not in INVISIBLE]
        return not letters or any(script(c) in ("LATIN", "GREEK", "CYRILLIC") for c in letters)


def rewritten(texts: DataFrame, column: str, forms: Forms, to: str = "unified") -> DataFrame:
    """texts with one more column: the text in one form. Equal to the text itself where nothing had to change."""
    schema = StructType([*texts.schema.fields, StructField(to, StringType())])
    at = texts.columns.index(column)
    shared = texts.sparkSession.sparkContext.broadcast((dict(forms), forms.across, forms.usual, forms.foreign))
    units = Rewriter(forms).units()
    # a cheap test in Arrow finds the few texts that hold a unit at all
    wanted = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted({u[-1] for u in units})) + "]"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        own, across, usual, foreign = shared.value
        table = Forms(own)
        table.across, table.usual, table.foreign = across, usual, foreign
        rewrite = Rewriter(table)
        for batch in batches:
            col = batch.column(at)
            if units:
                hits = pc.fill_null(pc.match_substring_regex(col, wanted), False)
                new = [rewrite(t) for t in col.filter(hits).to_pylist()]
                col = pc.replace_with_mask(col, hits, pa.array(new, col.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, col], names=[*batch.schema.names, to])

    return texts.mapInArrow(part, schema)


def unify(texts: DataFrame, column: str, to: str = "unified") -> DataFrame:
    """Bring a column of texts to one form, learned from all of its rows."""
    return rewritten(texts, column, representatives(census(texts, column)), to)
