"""Model providers behind one interface: a callable on a list of texts, run on Arrow batches inside tasks.

Embedding, generating and reading of images are calls of models that are not part of this library. A provider is any
importable callable; the ones here need no model and serve tests and baselines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that go to a provider in one call.
BATCH = 16
#: What is put before a question, but not before a passage, for it to be embedded.
INSTRUCTION = "Instruct: Given a document question, retrieve the passage that directly answers it.\nQuery: "


def shape_of(texts: list[str]) -> list[list[float]]:
    """A fake of four numbers, for tests of the plumbing."""
    return [[float(len(t) % 7), 1.0, 0.0, 0.5] for t in texts]


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Words hashed to signed dimensions: a vector in which texts that share rare words are near."""
    import xxhash

    out = []
    for text in texts:
        v = [0.0] * size
        for w in re.findall(r"[^\W_]{4,}", text.lower()):
            h = xxhash.xxh3_64_intdigest(w)
            v[h % size] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def embedded(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]], prefix: str = "") -> DataFrame:
    """vec_id, embedding of each row whose text is not null; the provider is called with BATCH texts at a time."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [prefix + t for t in batch["text"]]
            vectors = [v for at in range(0, len(texts), BATCH) for v in provider(texts[at : at + BATCH])]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": vectors})

    source = rows.select(F.col(key).alias("vec_id"), F.col(text).alias("text")).filter("vec_id is not null and text is not null")
    return source.mapInPandas(part, f"vec_id {dict(rows.dtypes)[key]}, embedding array<double>")
