"""Problem 5: near-duplicate records with small edits.

Equal texts form a class, whose key is a hash of the text; the work is on classes. Every class gets MinHash values of
its word runs: their low bits make a 64-bit fingerprint, in which the Hamming distance of two texts falls as their
Jaccard similarity rises; small groups of them make the keys of the shards in which it is stored. A shard's fingerprints are
searched with a BK-tree: children hang at their integer Hamming distance to the parent, and only the edges that can
hold something within the radius are followed. Pairs within the radius are checked exactly, on the sets of word runs.

A similarity of 0.6 needs a radius (25 of 64 bits) at which a tree prunes next to nothing, so the shards do the
pruning. At a similarity of 0.6 a pair shares at least one of BANDS shards with probability 0.997 and lies within the
radius with 0.9999; at 0.7 both are above 0.9999.

A shard that a sample of the texts shows to be hot is divided so that every two of its parts meet in a task of their
own. So the sample and the size of the input decide only how the work is dealt: whether a pair is found depends on its
two texts alone. The comparisons within a shard grow with the square of its rows.

Cases: null, empty and short texts (under MIN_WORDS words) take part in no pair; repeated rows and repeated texts of
one id count once; an id with several texts is compared by each; extra columns are ignored; ties do not arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from foliant.llm.words import mix, permutations, run_hashes, word_hash, words
from foliant.runtime import BROADCAST_BYTES, checkpoint, small_side

MIN_WORDS, RUN, THRESHOLD = 20, 3, 0.6
#: Shards of each text; MinHash values that name a shard; bits of a fingerprint.
BANDS, ROWS, BITS = 24, 3, 64
#: One text of so many is looked at to find hot shards; rows from which on a shard is divided; rows of the largest tree.
SAMPLE, HOT_ROWS, TREE_ROWS = 16, 1_000, 4_000
#: Hot shards that are broadcast at most, at 32 bytes each; with more the join is shuffled.
HOT_SHARDS = 1_000_000
SEED = 5


def radius(threshold: float, bits: int = BITS) -> int:
    """Hamming distance that a pair of the threshold's similarity exceeds with probability below 1e-4."""
    p = (1 - threshold) / 2
    return int(bits * p + 3.9 * (bits * p * (1 - p)) ** 0.5)


class BKTree:
    """Fingerprints by Hamming distance: a child hangs at its integer distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, list, dict[int, int]]] = []

    def add(self, fingerprint: int, item: object) -> None:
        at = 0
        while self.nodes:
            own, items, children = self.nodes[at]
            d = (own ^ fingerprint).bit_count()
            if d == 0:
                items.append(item)
                return
            if d not in children:
                children[d] = len(self.nodes)
                break
            at = children[d]
        self.nodes.append((fingerprint, [item], {}))

    def within(self, fingerprint: int, most: int) -> Iterator[object]:
        todo = [0] if self.nodes else []
        while todo:
            own, items, children = self.nodes[todo.pop()]
            d = (own ^ fingerprint).bit_count()
            if d <= most:
                yield from items
            todo += [child for edge, child in children.items() if d - most <= edge <= d + most]


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the texts that are long enough, their shard keys (n x BANDS), fingerprints."""
    split = [(k, w) for k, t in enumerate(texts) if len(w := words(t)) >= MIN_WORDS]
    n = len(split)
    keys, fingerprint = np.zeros((n, BANDS), np.uint64), np.zeros(n, np.uint64)
    if not split:
        return np.empty(0, np.int64), keys, fingerprint
    runs = [run_hashes(np.array([word_hash(x) for x in w], np.uint64), RUN) for _, w in split]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]])
    h = np.concatenate(runs)
    a, b = permutations(BANDS * ROWS + BITS, SEED)
    for k in range(len(a)):
        least = np.minimum.reduceat(h * a[k] + b[k], starts)
        bit = k - BANDS * ROWS
        if bit < 0:
            band = k // ROWS
            keys[:, band] = mix(keys[:, band] ^ least ^ np.uint64(band))
        else:
            # the low bits of a minimum are those of the product: any fixed bit of it is a fair coin
            fingerprint |= ((least >> np.uint64(17)) & np.uint64(1)) << np.uint64(bit)
    return np.array([k for k, _ in split]), keys, fingerprint


def shard_rows(texts: DataFrame) -> DataFrame:
    """key, text -> shard, key, fingerprint: a row for each distinct text of a partition and each of its shards."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            fresh = []
            for at, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(at)
            if len(seen) > 1_000_000:
                seen.clear()
            for at in range(0, len(fresh), 1000):
                piece = np.array(fresh[at : at + 1000])
                found, shards, fingerprint = signatures(batch.column(1).take(pa.array(piece)).to_pylist())
                key = batch.column(0).take(pa.array(np.repeat(piece[found], BANDS)))
                prints = np.repeat(fingerprint, BANDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shards.ravel().view(np.int64)), key, pa.array(prints)], names=["shard", "key", "fingerprint"])

    return texts.select("key", "text").mapInArrow(part, "shard long, key binary, fingerprint long")


def large(rows: DataFrame, most: int) -> DataFrame:
    """shard, n of the shards that, by a sample of one in SAMPLE texts, have more than so many rows."""
    return rows.groupBy("shard").agg((F.countDistinct("key") * SAMPLE).alias("n")).filter(F.col("n") > most)


def divided(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Shard rows with the two parts (i, j) of the shard that meet in a task, and the row's own part."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    held = small_side(hot, min(BROADCAST_BYTES, 32 * HOT_SHARDS))
    with_own = rows.join(held, "shard", "left").withColumn("own", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64("key"), parts).cast("int"))).withColumn("parts", parts)
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    return with_own.withColumn("other", other).select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "fingerprint")


def tree_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Pairs a < b of keys whose fingerprints lie within the radius in some shard."""

    def search(i: int, j: int, own: np.ndarray, keys: np.ndarray, prints: np.ndarray, pairs: set[tuple[bytes, bytes]]) -> None:
        tree, seen = BKTree(), set()
        for side, key, fingerprint in sorted(zip(own.tolist(), keys.tolist(), prints.view(np.uint64).tolist(), strict=True)):
            if (side, key) in seen:
                continue
            seen.add((side, key))
            if i == j or side == j:
                pairs.update((min(key, k), max(key, k)) for k in tree.within(fingerprint, most) if k != key)
            if i == j or side == i:
                tree.add(fingerprint, key)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[bytes, bytes]] = set()
        rest: list[np.ndarray] | None = None

        def given(pairs: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

        def work(columns: list[np.ndarray], last: bool) -> list[np.ndarray] | None:
            shard, i, j = columns[:3]
            n = len(shard)
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = np.concatenate([[0], new, [n]])
            ends = len(edges) - 1 if last else len(edges) - 2
            for g in np.flatnonzero(np.diff(edges[: ends + 1]) > 1).tolist():
                lo, hi = edges[g], edges[g + 1]
                search(int(i[lo]), int(j[lo]), *(c[lo:hi] for c in columns[3:]), pairs)
            return None if last else [c[edges[ends] :] for c in columns]

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if len(columns[0]):
                rest = work(columns, False)
            if len(pairs) > 500_000:
                yield given(pairs)
                pairs.clear()
        if rest is not None and len(rest[0]):
            work(rest, True)
        yield given(pairs)

    there = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return there.mapInArrow(part, "a binary, b binary").distinct()


def similar_classes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of unequal texts at least as similar as the threshold. texts: key, text. Gives a, b (keys, a < b), jaccard."""
    sampled = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)
    parts = F.greatest(F.lit(2), F.ceil(F.col("n") / TREE_ROWS)).cast("int")
    hot = large(shard_rows(sampled), min(HOT_ROWS, TREE_ROWS)).select("shard", parts.alias("parts"))
    pairs = checkpoint(tree_pairs(divided(shard_rows(texts), hot), radius(threshold)))
    held = among(texts, pairs.select(F.explode(F.array("a", "b")).alias("key"))).dropDuplicates(["key"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [jaccard(x, y) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "jaccard": got})

    both = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    checked = both.select("a", "b", "x", "y").mapInPandas(check, "a binary, b binary, jaccard double")
    return checked.filter(F.col("jaccard") >= threshold)


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the keys, by 64 bits of it, which are short to send; a chance row more does no harm before an exact join."""
    short = F.xxhash64("key").alias("_short")
    return rows.withColumn("_short", short).join(small_side(keys.select(short).distinct()), "_short", "left_semi").drop("_short")


def jaccard(x: str, y: str) -> float:
    """Similarity of the sets of word runs of two texts."""
    a, b = (set(zip(*(w[k:] for k in range(RUN)), strict=False)) for w in (words(x), words(y)))
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


def keyed(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the key of the text's class: 128 bits of a hash of the whole text."""
    return records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").withColumn("key", F.unhex(F.md5("text")))


@F.pandas_udf(BooleanType())
def long_enough(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words(t)) >= MIN_WORDS)


def near_duplicates(records: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """All pairs id_a < id_b of records whose texts are equal or at least as similar as the threshold."""
    texts = keyed(records, id_col, text_col)
    members = texts.select("id", "key").distinct()
    links = checkpoint(similar_classes(texts.select("key", "text"), threshold).select("a", "b"))
    left, right = members.select(F.col("id").alias("x"), F.col("key").alias("a")), members.select(F.col("id").alias("y"), F.col("key").alias("b"))
    unequal = links.join(left, "a").join(right, "b").select("x", "y")
    copied = members.groupBy("key").count().filter("count > 1").select("key")
    alike = among(texts, copied).dropDuplicates(["key"]).filter(long_enough("text")).select("key")
    copies = among(members, alike)
    equal = copies.select(F.col("id").alias("x"), "key").join(copies.select(F.col("id").alias("y"), "key"), "key").filter("x < y").select("x", "y")
    pairs = unequal.unionAll(equal).filter("x != y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of links a, b, by hooking each node to its least neighbour.

    Each round joins every node's neighbours to the least label among them and follows labels one step, so the rounds
    grow with the logarithm of the longest chain; each is cut by a checkpoint.
    """
    edges = checkpoint(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = checkpoint(labels)
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        hop = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = checkpoint(better.join(hop, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "before"))
        labels = after.select("node", "label")
        if after.filter("label != before").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def groups(records: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id (hash of its text), group_id, links (other classes its class is linked to): one row per record in a group.

    A group is a connected component of classes; records with equal texts are one class, whether linked or not.
    """
    texts = keyed(records, id_col, text_col)
    members = texts.select("id", "key").distinct()
    links = checkpoint(similar_classes(texts.select("key", "text"), threshold).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    of = components(links).withColumnRenamed("node", "key").join(degree, "key")
    copied = members.groupBy("key").count().filter("count > 1").select("key")
    known = of.select("key", "component", "links").unionAll(copied.join(of, "key", "left_anti").select("key", F.col("key").alias("component"), F.lit(0).cast("long").alias("links")))
    return members.join(known, "key").select("id", F.lower(F.hex("key")).alias("class_id"), F.lower(F.hex("component")).alias("group_id"), "links")
