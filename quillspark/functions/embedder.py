"""The default embedder: counts of words in hashed buckets, and the prompts around texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 768
# The 32-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def prompt_prefix(title: str) -> str:
    """What stands before a passage of a titled text."""
    return f"title: {title or 'none'} | text: "


def passage_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def bucket_of(word: str, dim: int = DIM) -> int:
    h = FNV_OFFSET
    for byte in word.encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFF
    return h % dim


def embed(text: str, dim: int = DIM) -> list[float]:
    out = [0.0] * dim
    for word in text.split():
        out[bucket_of(word, dim)] += 1.0
    return out


def embed_all(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The vectors of many texts, each distinct word hashed once."""
    out, known = np.zeros((len(texts), dim)), {}
    for i, text in enumerate(texts):
        for word in text.split():
            at = known.get(word)
            if at is None:
                at = known[word] = bucket_of(word, dim)
            out[i, at] += 1
    return out


def embed_column(text: Column, dim: int = DIM) -> Column:
    """The vectors of a column, in Arrow batches; null for null."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        made = iter(embed_all(texts[known].tolist(), dim).astype(np.float32))
        return pd.Series([next(made) if k else None for k in known])

    return vectors(text)
