"""Ranking of chunks for many questions at once.

Questions are a stated set; chunks are many. Every chunk is brought down once to the asked terms and phrases it holds,
and these meet the questions through postings, so that only what a chunk and a question share is multiplied. A question
with a scope meets the chunks of its documents alone. A task keeps its own best chunks of each question, and only those
are shuffled. Ranks are total orders: equal scores go by chunk id, in the order each ranking states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import ascii_tokens, index_tokens, terms
from foliant.runtime import checkpoint

POOL = 40
K1, B = 1.2, 0.75
#: Weights of the two lists in a fusion, and the constant that ranks are added to.
VECTOR_WEIGHT, KEYWORD_WEIGHT, RANK_CONSTANT = 1.0, 0.8, 60
#: Questions that one pass puts to all chunks.
BLOCK = 1 << 18
#: Query vectors that one pass compares with all vectors.
VECTORS = 1024
#: Questions without a scope that a task holds the best chunks of, and the cells (chunks x questions) it fills at once.
GROUP, ROWS = 8192, 512
#: Rows of (question, document of its scope) that one task takes, about, and products it holds at once.
SCOPED, PRODUCTS = 200_000, 4_000_000


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n counts: each position as often as it counts, and 0, 1, 2, ... within each."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(row: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.ListArray]:
    """Columns of entries, each of a row, as one list for each row."""
    order = np.argsort(row, kind="stable")
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(c[order], pa.int32())) for c in columns]


def entries(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each entry of a column of lists."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False)


def counted(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of numbers (the second below size) and how often each occurs."""
    key, times = np.unique(first.astype(np.int64) * size + second, return_counts=True)
    return key // size, key % size, times


def found_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted known ones, and whether it is one of them."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Asked:
    """The questions of a pass and their terms as numbers."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("question_id").combine_chunks()
        self.open = ~rows.column("scoped").combine_chunks().to_numpy(zero_copy_only=False)
        terms_of = rows.column("terms").combine_chunks()
        self.question = entries(terms_of)[0]
        coded = terms_of.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.size = len(self.ids), max(len(self.words), 1)


class Weights:
    """What each feature of a chunk is worth to each question: rows of (question, feature, weight), by question."""

    def __init__(self, questions: int, question: np.ndarray, feature: np.ndarray, weight: np.ndarray):
        order = np.argsort(question, kind="stable")
        self.feature, self.weight = feature[order].astype(np.int32), weight[order].astype(np.float64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(question, minlength=questions))])

    def of(self, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among the given questions, feature and weight of their rows."""
        own, step = spread(np.diff(self.starts)[questions])
        at = self.starts[questions][own] + step
        return own, self.feature[at], self.weight[at]


class Postings:
    """Weighted places by key."""

    def __init__(self, key: np.ndarray, place: np.ndarray, weight: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.known, self.starts, self.sizes = np.unique(key[order], return_index=True, return_counts=True)
        self.place, self.weight = place[order], weight[order]

    def met(self, row: np.ndarray, key: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place, product) of the entries, in slices that hold whole rows; entries come row by row."""
        at, there = found_in(self.known, key)
        row, at, value = row[there], at[there], value[there]
        if not len(row):
            return
        done = np.cumsum(self.sizes[at])
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
        lo = 0
        while lo < len(row):
            before = done[lo - 1] if lo else 0
            k = np.searchsorted(ends, max(np.searchsorted(done, before + PRODUCTS, "right"), lo + 1), "right") - 1
            hi = ends[k] if k >= 0 and ends[k] > lo else ends[np.searchsorted(ends, lo, "right")]
            own, step = spread(self.sizes[at[lo:hi]])
            where = self.starts[at[lo:hi]][own] + step
            yield row[lo:hi][own], self.place[where], value[lo:hi][own] * self.weight[where]
            lo = hi


class Best:
    """The k best chunks of each question that a task has seen; of equal scores the least id, or the greatest."""

    def __init__(self, questions: int, k: int, greatest: bool):
        self.k, self.greatest = k, greatest
        self.floor = np.full(questions, np.finfo(float).tiny)  # a score of 0 is none
        self.question, self.score, self.seq, self.names = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new: list[np.ndarray] = []
        self.size = self.known = 0

    def named(self, ids: np.ndarray) -> int:
        """Chunks that are scored next; gives the number of the first."""
        self.new.append(ids)
        self.known += len(ids)
        return self.known - len(ids)

    def offer(self, question: np.ndarray, score: np.ndarray, seq: np.ndarray) -> None:
        """seq: the chunk's number."""
        near = score >= self.floor[question] - 1e-6
        score = np.round(score[near], 6)
        question, seq = question[near], seq[near]
        kept = score >= self.floor[question]
        self.held.append((question[kept], score[kept], seq[kept]))
        self.size += int(kept.sum())
        if self.size > 2 * self.k * len(self.floor) + PRODUCTS // 8:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """question (its position), score, id of what is kept."""
        if self.held:
            question, score, seq = (np.concatenate(x) for x in zip(*self.held, strict=True))
            names = np.concatenate([np.asarray(x, object) for x in self.new]) if self.new else np.empty(0, object)
            seen, own = np.unique(seq, return_inverse=True)
            names = names[seen]
            place = np.empty(len(names), np.int64)
            place[np.argsort(names, kind="stable")] = np.arange(len(names))
            by_id = place[own]
            order = np.lexsort((-by_id if self.greatest else by_id, -score, question))
            question, score, own = question[order], score[order], own[order]
            rank = np.arange(len(question)) - np.searchsorted(question, question)
            last = rank == self.k - 1
            self.floor[question[last]] = score[last]
            kept = rank < self.k
            self.question, self.score, self.seq, self.names = question[kept], score[kept], own[kept], names
            self.held, self.new, self.known, self.size = [(self.question, self.score, self.seq)], [names], len(names), int(kept.sum())
        return self.question, self.score, self.names[self.seq]


def passes(questions: DataFrame) -> Iterator[tuple[Asked, DataFrame]]:
    """The questions of each pass with their terms, and (question_id, document_id) of the scopes they are asked within.

    questions: question_id, question, and optionally scope, the documents each is asked of (null or empty: all).
    """
    scope = F.col("scope") if "scope" in questions.columns else F.lit(None).cast("array<string>")
    asked = questions.select("question_id", terms(F.col("question")).alias("terms"), scope.alias("scope")).filter("question_id is not null and size(terms) > 0")
    asked = checkpoint(asked.withColumn("scoped", F.coalesce(F.size("scope"), F.lit(0)) > 0))
    parts = max(1, -(-asked.count() // BLOCK))
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part)
        within = own.filter("scoped").select("question_id", F.explode(F.array_distinct("scope")).alias("document_id")).filter("document_id is not null")
        yield Asked(own.select("question_id", "terms", "scoped").toArrow()), within


def document_of(chunks: DataFrame) -> Column:
    return (F.col("document_id") if "document_id" in chunks.columns else F.lit(None).cast("string")).alias("document_id")


def with_features(source: DataFrame, maker: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """source (chunk_id, document_id, tokens) as chunk_id, document_id, length, at (features), times. maker makes, in the task, what finds them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = maker()
        for batch in batches:
            tokens = batch.column(2)
            length = pc.cast(pc.fill_null(pc.list_value_length(tokens), 0), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], length, *features(tokens)], names=["chunk_id", "document_id", "length", "at", "times"])

    return checkpoint(source.mapInArrow(part, "chunk_id string, document_id string, length int, at array<int>, times array<int>"))


def best_chunks(encoded: DataFrame, asked: Asked, within: DataFrame, weights: Weights, value: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, greatest: bool) -> DataFrame:
    """question_id, chunk_id, score: the k best chunks of each question, task by task. value: times, length -> what an entry counts.

    Questions without a scope meet all chunks, by groups. Those with one meet the chunks of its documents alone: both are
    dealt by document.
    """
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast((asked.ids, weights))
    kind = dict(within.dtypes)["question_id"]
    out = pa.schema([("question_id", asked.ids.type), ("chunk_id", pa.string()), ("score", pa.float64())])
    form = f"question_id {kind}, chunk_id string, score double"

    def given(ids: pa.Array, best: Best) -> list[pa.Array]:
        question, score, names = best.rows()
        return [ids.take(pa.array(question, pa.int64())), pa.array(names, pa.string()), pa.array(score, pa.float64())]

    def anywhere(block: np.ndarray) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, all_weights = shared.value
            own, feature, weight = all_weights.of(block)
            postings, best = Postings(feature, own, weight), Best(len(block), k, greatest)
            cells = max(1, ROWS * GROUP // len(block))
            for batch in batches:
                for at in range(0, batch.num_rows, min(cells, 4096)):
                    piece = batch.slice(at, min(cells, 4096))
                    row, found = entries(piece.column("at"))
                    worth = value(entries(piece.column("times"))[1], piece.column("length").to_numpy(zero_copy_only=False)[row])
                    scores = np.zeros(piece.num_rows * len(block))
                    first = best.named(piece.column("chunk_id").to_numpy(zero_copy_only=False))
                    for r, q, product in postings.met(row, found, worth):
                        low = int(r[0])
                        span = slice(low * len(block), (int(r[-1]) + 1) * len(block))
                        scores[span] += np.bincount((r - low) * len(block) + q, product, minlength=span.stop - span.start)
                    there = np.flatnonzero(scores.reshape(piece.num_rows, -1) >= best.floor - 1e-6)
                    best.offer(there % len(block), scores[there], first + there // len(block))
            yield pa.RecordBatch.from_arrays(given(ids.take(pa.array(block)), best), schema=out)

        # a task keeps the best of all its chunks, so there are no more tasks than cores call for
        return encoded.coalesce(2 * context.defaultParallelism).mapInArrow(part, form)

    def scoped(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, all_weights = shared.value
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        wanted = pc.unique(right.column("document_id"))
        left = left.filter(pc.is_in(left.column("document_id"), value_set=wanted)).combine_chunks()
        if not left.num_rows:
            return out.empty_table()
        place = lambda c, known: pc.index_in(c, value_set=known).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        of_question, document = place(right.column("question_id"), ids), place(right.column("document_id"), wanted)
        asking, here = np.unique(of_question, return_inverse=True)
        size = int(all_weights.feature.max(initial=0)) + 1
        own, feature, weight = all_weights.of(of_question)
        postings, best = Postings(document[own] * size + feature, here[own], weight), Best(len(asking), k, greatest)
        lists_of = lambda c: entries(left.column(c).combine_chunks())
        row, found = lists_of("at")
        known = found < size
        worth = value(lists_of("times")[1], left.column("length").to_numpy()[row])
        key = place(left.column("document_id"), wanted)[row] * size + found
        best.named(left.column("chunk_id").combine_chunks().to_numpy(zero_copy_only=False))
        for r, q, product in postings.met(row[known], key[known], worth[known]):
            cell = r * len(asking) + q
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            best.offer(cell[starts] % len(asking), np.add.reduceat(product[order], starts), cell[starts] // len(asking))
        return pa.Table.from_arrays(given(ids.take(pa.array(asking)), best), schema=out)

    free = np.flatnonzero(asked.open)
    found = [anywhere(free[at : at + GROUP]) for at in range(0, len(free), GROUP)]
    if len(free) < asked.n:
        buckets = max(context.defaultParallelism, -(-within.count() // SCOPED))
        dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets))).groupBy("bucket")
        found.append(dealt(encoded.filter("document_id is not null")).cogroup(dealt(within)).applyInArrow(scoped, form))
    return reduce(DataFrame.unionAll, found) if found else encoded.sparkSession.createDataFrame([], form)


def top(scored: DataFrame, k: int, greatest: bool = False) -> DataFrame:
    """The k best rows of each question with their rank; equal scores go by chunk id, the least first or the greatest."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("chunk_id") if greatest else F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(chunks: DataFrame, questions: DataFrame, pool: int = POOL) -> DataFrame:
    """question_id, chunk_id, score, rank: the best chunks by BM25, in which the phrase of all terms counts as one more term.

    Statistics are those of all chunks given: one pass finds the asked terms and phrases of each chunk, the next counts
    in how many chunks each stands. Equal scores go by id.
    """
    source = chunks.select(F.col("id").alias("chunk_id"), document_of(chunks), index_tokens(F.col("content")).alias("tokens")).filter("chunk_id is not null")
    return top(reduce(DataFrame.unionAll, (bm25_pass(source, asked, within, pool) for asked, within in passes(questions))), pool)


class Phrases:
    """The different terms of each question one behind the other, met by their first two."""

    def __init__(self, asked: Asked):
        first = np.sort(np.unique(asked.question * asked.size + asked.codes, return_index=True)[1])
        question, self.codes = asked.question[first], asked.codes[first]
        lengths = np.bincount(question, minlength=asked.n)
        starts = np.cumsum(lengths) - lengths
        several = np.flatnonzero(lengths >= 2)
        pair = self.codes[starts[several]] * asked.size + self.codes[starts[several] + 1]
        order = np.argsort(pair, kind="stable")
        self.size, self.pairs, self.question = asked.size, pair[order], several[order]
        self.starts, self.lengths = starts[self.question], lengths[self.question]

    def within(self, row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, question) of each place where a question's phrase stands. codes: the terms of the rows in order, -1 for others."""
        at = np.flatnonzero((row[1:] == row[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0))
        key = codes[at] * self.size + codes[at + 1]
        low = np.searchsorted(self.pairs, key)
        own, step = spread(np.searchsorted(self.pairs, key, "right") - low)
        at, phrase = at[own], low[own] + step
        met = [(at, phrase)]
        end = np.append(codes, -1)
        for deep in range(2, int(self.lengths.max(initial=0))):
            at, phrase = met.pop()
            done = self.lengths[phrase] <= deep
            met.append((at[done], phrase[done]))
            at, phrase = at[~done], phrase[~done]
            to = np.minimum(at + deep, len(codes))
            same = (end[to] == self.codes[self.starts[phrase] + deep]) & (np.append(row, -1)[to] == row[at])
            met.append((at[same], phrase[same]))
        at, phrase = (np.concatenate(x) for x in zip(*met, strict=True))
        return row[at], self.question[phrase]


def bm25_pass(source: DataFrame, asked: Asked, within: DataFrame, pool: int) -> DataFrame:
    context = source.sparkSession.sparkContext
    shared = context.broadcast((asked.words, asked.size, Phrases(asked)))
    n_features = asked.size + asked.n

    def maker() -> Callable[[pa.Array], list[pa.Array]]:
        words, size, phrases = shared.value

        def features(tokens: pa.Array) -> list[pa.Array]:
            row = entries(tokens)[0]
            codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = codes >= 0
            r, term, times = counted(row[known], codes[known], size)
            s, question, often = counted(*phrases.within(row, codes), n_features)
            return lists(np.concatenate([r, s]), len(tokens), np.concatenate([term, size + question]), np.concatenate([times, often]))

        return features

    encoded = with_features(source, maker)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, length, of = 0, 0, np.zeros(n_features, np.int64)
        for batch in batches:
            chunks, length = chunks + batch.num_rows, length + (pc.sum(batch.column(0)).as_py() or 0)
            of += np.bincount(entries(batch.column(1))[1], minlength=n_features)
        at = of.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at]), pa.int64()), pa.array(np.concatenate([[chunks, length], of[at]]), pa.int64())], names=["at", "n"])

    # what is asked for bounds these rows, not the chunks
    rows = encoded.select("length", "at").coalesce(2 * context.defaultParallelism).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "n"))
    df = np.zeros(n_features + 2)
    df[at + 2] = n
    (chunks, length), df = df[:2], df[2:]
    average = max(length, 1) / max(chunks, 1)
    idf = np.log((chunks - df + 0.5) / (df + 0.5))
    idf = np.where(idf <= 0, 1e-6, idf)
    question, term, _ = counted(asked.question, asked.codes, asked.size)
    whole = np.arange(asked.n)[df[asked.size :] > 0]
    feature = np.concatenate([term, asked.size + whole])
    weights = Weights(asked.n, np.concatenate([question, whole]), feature, idf[feature])

    def value(times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / average))

    return best_chunks(encoded, asked, within, weights, value, pool, False)


def lexical(chunks: DataFrame, questions: DataFrame, pool: int = POOL) -> DataFrame:
    """question_id, chunk_id, score, rank: overlap of terms (at most two each) and twice the length of each shared 2- or 3-word phrase.

    Phrases are met as substrings: their first word may end a longer one, their last may begin one. Of equal scores the
    greatest id is first.
    """
    pieces = F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9]+)( (?=[a-z0-9]))?"), 0)  # a token, and the blank that alone parts it from the next
    source = chunks.select(F.col("id").alias("chunk_id"), document_of(chunks), pieces.alias("tokens")).filter("chunk_id is not null")
    return top(reduce(DataFrame.unionAll, (lexical_pass(source, asked, within, pool) for asked, within in passes(questions))), pool, True)


class Parts:
    """Which asked terms a word is, ends with and begins with."""

    def __init__(self, words: list[str]):
        self.at = {w: k for k, w in enumerate(words)}
        self.known: dict[str, tuple[int, list[int], list[int]]] = {}

    def of(self, word: str) -> tuple[int, list[int], list[int]]:
        got = self.known.get(word)
        if got is None:
            at, n = self.at, len(word)
            got = at.get(word, -1), [at[w] for k in range(n - 2) if (w := word[k:]) in at], [at[w] for k in range(3, n + 1) if (w := word[:k]) in at]
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got


def lexical_pass(source: DataFrame, asked: Asked, within: DataFrame, pool: int) -> DataFrame:
    size, question, codes = asked.size, asked.question, asked.codes
    two = np.flatnonzero(question[1:] == question[:-1]) if len(question) else np.empty(0, np.int64)
    three = two[np.isin(two + 1, two)]
    pairs, pair_of = np.unique(codes[two] * size + codes[two + 1], return_inverse=True)
    triples, triple_of = np.unique(pair_of[np.searchsorted(two, three)] * size + codes[three + 2], return_inverse=True)
    shared = source.sparkSession.sparkContext.broadcast((asked.words, size, pairs, triples))
    every = size + len(pairs) + len(triples)
    q, term, times = counted(question, codes, size)
    of_two, of_three = counted(question[two], pair_of, every), counted(question[three], triple_of, every)
    feature = np.concatenate([term, size + of_two[1], size + len(pairs) + of_three[1]])
    weights = Weights(asked.n, np.concatenate([q, of_two[0], of_three[0]]), feature, np.concatenate([times, 4 * of_two[2], 6 * of_three[2]]))

    def maker() -> Callable[[pa.Array], list[pa.Array]]:
        words, size, pairs, triples = shared.value
        parts = Parts(words.to_pylist())

        def features(tokens: pa.Array) -> list[pa.Array]:
            row = entries(tokens)[0]
            coded = tokens.flatten().dictionary_encode()
            seen, own = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            of = [parts.of(w[:-1] if w.endswith(" ") else w) for w in seen]
            is_term, goes_on = np.array([x[0] for x in of], np.int64), np.array([w.endswith(" ") for w in seen], bool)
            table = lambda k: (n := np.array([len(x[k]) for x in of], np.int64), np.cumsum(n) - n, np.array([t for x in of for t in x[k]], np.int64))
            (n_ends, ends_at, ends), (n_begins, begins_at, begins) = table(1), table(2)
            whole, go = (is_term[own], goes_on[own]) if len(own) else (np.empty(0, np.int64), np.empty(0, bool))
            known = whole >= 0
            r, term, times = counted(row[known], whole[known], size)
            at = np.flatnonzero(go[:-1])
            before, after = own[at], own[at + 1]
            k, step = spread(n_ends[before] * n_begins[after] if len(at) else np.empty(0, np.int64))
            at, before, after = at[k], before[k], after[k]
            last = begins[begins_at[after] + step % n_begins[after]] if len(k) else np.empty(0, np.int64)
            pair, there = found_in(pairs, (ends[ends_at[before] + step // n_begins[after]] if len(k) else last) * size + last)
            at, pair, last = at[there], pair[there], last[there]
            # a third word follows a second that is whole
            deep = np.flatnonzero((whole[at + 1] == last) & go[at + 1]) if len(at) else np.empty(0, np.int64)
            third = own[at[deep] + 2] if len(deep) else np.empty(0, np.int64)
            k, step = spread(n_begins[third] if len(third) else np.empty(0, np.int64))
            triple, met = found_in(triples, (pair[deep][k] * size + begins[begins_at[third[k]] + step]) if len(k) else np.empty(0, np.int64))
            rows = np.concatenate([row[at], row[at[deep][k][met]]])
            s, phrase, _ = counted(rows, np.concatenate([pair, len(pairs) + triple[met]]), every)
            return lists(np.concatenate([r, s]), len(tokens), np.concatenate([term, size + phrase]), np.concatenate([np.minimum(times, 2), np.ones(len(s), np.int64)]))

        return features

    return best_chunks(with_features(source, maker), asked, within, weights, lambda times, lengths: times, pool, True)


def cosine(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """query_id, vec_id, similarity, rank of the k nearest vectors of each query by cosine, exactly.

    The stated queries go to the tasks in blocks; each task keeps its own k nearest, which alone are shuffled. Zero
    vectors and nulls are near nothing.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").filter("embedding is not null")
    rows = asked.count()
    spark = vectors.sparkSession
    source = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")

    def nearest(block: int, blocks: int) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in own], unit(np.array([r["embedding"] for r in own], np.float64))))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                near = q @ unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64)).T
                keep = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
                floor = np.take_along_axis(near, keep, 1).min(axis=1)
                at, which = np.nonzero(near >= floor[:, None])  # ties at the edge stay for the final order
                yield pd.DataFrame({"query_id": np.array(ids, object)[at], "vec_id": batch["vec_id"].to_numpy()[which], "similarity": near[at, which]})

        return source.mapInPandas(part, f"query_id {dict(queries.dtypes)['vec_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, similarity double")

    blocks = max(1, -(-rows // VECTORS))
    found = reduce(DataFrame.unionAll, (nearest(b, blocks) for b in range(blocks))).withColumn("similarity", F.round("similarity", 6))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fused(first: DataFrame, second: DataFrame, weight: float = VECTOR_WEIGHT, other: float = KEYWORD_WEIGHT, constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: question_id, chunk_id, first_rank, second_rank, score."""
    both = first.select("question_id", "chunk_id", F.col("rank").alias("first_rank")).join(second.select("question_id", "chunk_id", F.col("rank").alias("second_rank")), ["question_id", "chunk_id"], "full")
    part: Column = F.coalesce(weight / (constant + F.col("first_rank")), F.lit(0.0)) + F.coalesce(other / (constant + F.col("second_rank")), F.lit(0.0))
    return both.withColumn("score", F.round(part, 9))


def term_counts(texts: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """key, term, tf of the plain terms of each text."""
    return texts.select(key, F.explode(ascii_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
