"""Problem 6: texts into windows of fixed capacity.

Sizes are counts of tokens of a public tokenizer, taken over whole texts. The texts are dealt into random groups of
about GROUP texts; in each group they are packed first-fit decreasing: a tournament tree over the bins holds in each
node the most room of the bins below it, so the first bin with room is found in the logarithm of the number of bins.
Only (id, size) is shuffled. A larger group wastes no more in theory than 11/9 of the least number of bins plus one bin; with
thousands of texts to a group the part that the groups' last bins waste is small.

Cases: a text longer than the window is cut into parts of exactly the capacity, each alone in its bin, and a rest that
is packed like a text; null and empty texts have no tokens and are packed last, in a bin with others; every row of the
input is packed, equal texts and repeated ids too; windows with no or no positive capacity are left out; ties of size
are packed by id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("FOLIANT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how texts are split before the merges of this vocabulary apply.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP, SEED = 4096, 6
#: Tasks among which the groups are dealt at most.
PARTS = 10_000
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a file of ranks; one per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Tournament:
    """Bins in order of opening; each node of the tree knows the most room below it."""

    def __init__(self, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * (2 * self.leaves)

    def set(self, bin_no: int, room: int) -> None:
        at = bin_no + self.leaves
        self.room[at] = room
        while at > 1:
            at >>= 1
            most = max(self.room[2 * at], self.room[2 * at + 1])
            if self.room[at] == most:
                break
            self.room[at] = most

    def first(self, size: int) -> int:
        """The first bin with so much room, or -1."""
        if self.room[1] < size:
            return -1
        at = 1
        while at < self.leaves:
            at = 2 * at if self.room[2 * at] >= size else 2 * at + 1
        return at - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, given in decreasing size; no item is larger than the capacity."""
    tree, opened, at = Tournament(len(sizes)), 0, []
    for size in sizes:
        k = tree.first(size) if opened and size else (0 if opened else -1)
        if k < 0:
            k, opened = opened, opened + 1
            tree.set(k, capacity - size)
        elif size:
            tree.set(k, tree.room[k + tree.leaves] - size)
        at.append(k)
    return at


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """id, n_tokens of each row."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(part, f"id {dict(documents.dtypes)[id_col]}, n_tokens long")


def packed(documents: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """window_id, id, part, first_token, n_tokens, bin_id: for each window, where each part of each text goes.

    windows (window_id, capacity_tokens) is a settings table of a few rows.
    """
    kept = windows.select("window_id", "capacity_tokens").filter("window_id is not null and capacity_tokens > 0").distinct()
    capacities = sorted((r["window_id"], r["capacity_tokens"]) for r in kept.collect())
    groups = max(1, -(-documents.count() // group))
    kind = dict(documents.dtypes)[id_col]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        number = int(rows["group"].iloc[0]) << 32
        out = []
        for window, capacity in capacities:
            cuts = rows["n_tokens"] > capacity
            opened = 0
            for i, n in zip(rows["id"][cuts], rows["n_tokens"][cuts], strict=True):
                for k in range(n // capacity):
                    out.append((window, i, k, k * capacity, capacity, number + opened))
                    opened += 1
            rest = [(n % capacity, n // capacity, i) for i, n in zip(rows["id"][cuts], rows["n_tokens"][cuts], strict=True) if n % capacity]
            rest += [(n, 0, i) for i, n in zip(rows["id"][~cuts], rows["n_tokens"][~cuts], strict=True)]
            rest.sort(key=lambda x: -x[0])
            for (n, k, i), at in zip(rest, first_fit_decreasing([n for n, _, _ in rest], capacity), strict=True):
                out.append((window, i, k, k * capacity, n, number + opened + at))
        return pd.DataFrame(out, columns=["window_id", "id", "part", "first_token", "n_tokens", "bin_id"])

    sized = token_counts(documents, id_col, text_col, tokenizer).withColumn("group", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(groups)))
    # few bytes, but much work: a number of parts that is not merged by bytes
    spread = sized.repartition(min(groups, PARTS), "group")
    return spread.groupBy("group").applyInPandas(pack, f"window_id int, id {kind}, part int, first_token long, n_tokens long, bin_id long").withColumnRenamed("id", id_col)


def fill(placed: DataFrame, windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """window_id, bins, least_bins, texts, gaps, overfull, waste: what a packing must keep to, and the share of room it leaves unused.

    least_bins is what the tokens alone would fill; gaps counts texts whose parts do not make up the text; overfull is
    whether any bin holds more than the window.
    """
    room = windows.select("window_id", "capacity_tokens").distinct()
    per_bin = placed.groupBy("window_id", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("window_id").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    parts = placed.groupBy("window_id", id_col).agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("parts"), F.countDistinct("part").alias("different"))
    per_text = parts.groupBy("window_id").agg(F.count("*").alias("texts"), F.count_if((F.col("n") != F.col("end")) | (F.col("parts") != F.col("different"))).alias("gaps"))
    waste = 1 - F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))
    return per_bin.join(per_text, "window_id").join(F.broadcast(room), "window_id").select("window_id", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), "texts", "gaps", waste.alias("waste"), (F.col("fullest") > F.col("capacity_tokens")).alias("overfull"))
