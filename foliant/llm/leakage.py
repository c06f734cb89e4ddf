"""Problem 7: passages of held-out test items inside a training corpus.

Size-partitioned MinHash containment search (LSH Ensemble). What is looked for are short passages: every item of at
least RUN words is covered by overlapping passages of PASSAGE words, so that any RUN consecutive words of it hold one
passage whole; a shorter item is looked for by its beginning. What is searched are whole documents, as the sets of their
shingles that some item has at all, for no other shingle can be shared. These sets differ in size from one shingle to
many, and are partitioned by size (powers of two); a partition's largest size turns full containment of a passage into
a least Jaccard similarity, which sets how many MinHash bands are needed to meet it with probability RECALL. A document
with more than DOMAIN such shingles is searched in stretches of DOMAIN that overlap by a passage. It is a candidate for
an item when a band of it and of one of the item's passages agree; candidates are verified exactly, on word runs.

The corpus is read once for each block of at most ITEMS items and is not shuffled; the block is prepared once and sent
to the tasks as arrays of bounded size.

Cases: null or empty texts hold nothing and items without words are never found; an item of fewer words than a
shingle is searched by shingles of its own length; repeated rows give one pair; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.words import permutations, run_hashes, word_hash, words

RUN, PASSAGE, SHINGLE = 12, 9, 5
#: Shingles of a document that are compared as one set at most.
DOMAIN = 64
RECALL = 1 - 1e-6
#: Items whose passages are sent to the tasks at once; more items are searched block by block.
ITEMS = 20_000
SEED = 20


def bands_needed(passage: int, domain: int, recall: float = RECALL) -> int:
    """One-row bands with which a passage of so many shingles meets a set of so many that contains it."""
    similarity = passage / max(domain, passage)
    return 1 if similarity >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def positions(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values that are among the known (sorted) stand, and which they are."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    there = np.flatnonzero(known[at] == values)
    return there, at[there]


class Passages:
    """The passages of items by their shingles of one length, ready to be met by sets of shingles of documents."""

    def __init__(self, shingle: int, passages: list[tuple[int, np.ndarray]]):
        self.shingle = shingle
        self.owner = np.array([i for i, _ in passages])
        self.known = np.unique(np.concatenate([h for _, h in passages]))
        width = max(len(h) for _, h in passages)
        #: shingles of each passage; shorter ones repeat their last
        self.of = np.array([np.searchsorted(self.known, np.concatenate([h, np.repeat(h[-1:], width - len(h))])) for _, h in passages], np.int32)
        pairs = np.unique(np.column_stack([self.of.ravel(), np.repeat(np.arange(len(passages)), width)]), axis=0)
        self.having, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))
        least = min(len(np.unique(h)) for _, h in passages)
        self.bands = {size: bands_needed(least, size) for size in (1 << k for k in range(DOMAIN.bit_length()))}
        self.a, self.b = permutations(max(self.bands.values()), SEED + shingle)

    def domains(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents' sets: known shingles one behind the other; document, start and size of each set."""
        found = [positions(self.known, run_hashes(c, self.shingle))[1] for c in codes]
        step = DOMAIN - (self.of.shape[1] - 1)
        sets = [(d, at, min(DOMAIN, len(f) - at)) for d, f in enumerate(found) for at in range(0, max(1, len(f) - DOMAIN + step), step) if len(f)]
        before = np.cumsum([0, *map(len, found)])
        document, start, size = np.array(sets, np.int64).reshape(-1, 3).T
        return np.concatenate(found), document, start + before[document], size

    def met(self, codes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) where a band of a document's set and of a passage of the item agree."""
        out: set[tuple[int, int]] = set()
        if not codes:
            return out
        shingles, document, start, size = self.domains(codes)
        for most, bands in self.bands.items():
            chosen = np.flatnonzero((size <= most) & (size > most // 2))
            if not len(chosen):
                continue
            place = np.minimum(np.arange(most), size[chosen, None] - 1)
            own = shingles[start[chosen, None] + place]
            values = self.known[own]
            rows = np.arange(len(chosen))
            for band in range(bands):
                permuted = values * self.a[band] + self.b[band]
                at = permuted.argmin(axis=1)
                shingle, least = own[rows, at], permuted[rows, at]
                n = self.first[shingle + 1] - self.first[shingle]
                row = np.repeat(rows, n)
                passage = self.having[np.repeat(self.first[shingle] - (n.cumsum() - n), n) + np.arange(n.sum())]
                same = (self.known[self.of[passage]] * self.a[band] + self.b[band]).min(axis=1) == least[row]
                out.update(zip(document[chosen][row[same]].tolist(), self.owner[passage[same]].tolist(), strict=True))
        return out


class Items:
    """A bounded block of items, prepared once for all tasks."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        kept = [(i, w) for i, w in items if w]
        self.texts = {i: f" {' '.join(w)} " for i, w in kept}
        self.length = {i: min(RUN, len(w)) for i, w in kept}
        self.code = {w: np.uint64(word_hash(w)) for _, ws in kept for w in ws}
        coded = [(i, np.array([self.code[x] for x in w], np.uint64)) for i, w in kept]
        by_shingle, by_run = defaultdict(list), defaultdict(list)
        for i, c in coded:
            n = min(SHINGLE, len(c))
            starts = range(0, len(c) - PASSAGE + 1, RUN - PASSAGE + 1) if len(c) >= RUN else (0,)
            by_shingle[n] += [(i, run_hashes(c[at : at + PASSAGE], n)) for at in starts]
            by_run[self.length[i]].append(run_hashes(c, self.length[i]))
        self.passages = [Passages(n, p) for n, p in by_shingle.items()]
        #: length of a run -> sorted hashes of all items' runs of that length
        self.runs = {n: np.unique(np.concatenate(each)) for n, each in by_run.items()}

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(position of the text, item) where RUN consecutive words of the item, or all of a shorter item, stand in the text."""
        split = [words(t) for t in texts]
        get, none = self.code.get, np.uint64(0)
        codes = [np.array([get(x, none) for x in w], np.uint64) for w in split]
        found: list[tuple[int, int]] = []
        runs: dict[tuple[int, int], list[str]] = {}
        for document, item in sorted(set().union(*(p.met(codes) for p in self.passages))):
            n = self.length[item]
            if (document, n) not in runs:  # the document's runs of n words that some item has
                at = positions(self.runs[n], run_hashes(codes[document], n))[0]
                runs[document, n] = [f" {' '.join(split[document][k : k + n])} " for k in at.tolist()]
            if any(run in self.texts[item] for run in runs[document, n]):
                found.append((document, item))
        return found


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) of each document that holds RUN consecutive words of an item, or all words of a shorter item."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc_id]
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    blocks = max(1, -(-wanted.count() // ITEMS))

    def against(block: int) -> DataFrame:
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toLocalIterator()
        index = spark.sparkContext.broadcast(Items([(r["item"], words(r["text"])) for r in rows]))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    found = index.value.search(batch["text"].iloc[at : at + 500].tolist())
                    yield pd.DataFrame({"doc": batch["doc"].iloc[[at + k for k, _ in found]].to_numpy(), "item": [i for _, i in found]})

        source = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
        return source.mapInPandas(part, f"doc {kind}, item {dict(items.dtypes)[item_id]}")

    found = reduce(DataFrame.unionAll, (against(k) for k in range(blocks)))
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias("item_id"))
