"""Deterministic text embeddings by signed feature hashing, as Arrow-batched expressions.

They are lexical: texts are close if they share words and word parts. They stand in where no model is at hand, and don't
claim to rank as a trained model would.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKENS = 8192
# Fixed value: what a query text begins with before it is embedded.
QUERY_PREFIX = "Represent this query for searching relevant code: "
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each token, made once in a worker; forgotten when there are a million."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.lower(), 17)
        return value


_HASHES = _Hashes()


def hash_vectors(texts: list[str], dim: int) -> list[np.ndarray | None]:
    """Unit vector of each text; None for one without a token.

    Features are sub-word tokens, at most ``MAX_TOKENS``, and pairs of neighbours; a pair's hash is mixed from those of its
    tokens. The features of all texts are counted in one go.
    """
    tokens = [_PART.findall(t)[:MAX_TOKENS] for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    h = np.array([_HASHES[t] for own in tokens for t in own], np.uint64)
    pair = (h[:-1] * _MIX ^ (h[1:] >> np.uint64(7))) * _MIX
    inside = owner[:-1] == owner[1:]
    h, owner = np.concatenate([h, pair[inside]]), np.concatenate([owner, owner[:-1][inside]])
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    place = owner * dim + ((h >> np.uint64(20)) % np.uint64(dim)).astype(np.int64)
    vectors = np.bincount(place, sign, len(texts) * dim).reshape(len(texts), dim)
    lengths = np.linalg.norm(vectors, axis=1)
    unit = (vectors / np.where(lengths > 0, lengths, 1)[:, None]).astype(np.float32)
    return [u if n else None for u, n in zip(unit, lengths)]


def embed(text: Column, dim: int = 64, prefix: str = "") -> Column:
    """Embedding of ``prefix`` + ``text``; null for a null text and for one without a token."""

    @F.pandas_udf("array<float>")
    def embed_batch(batch: pd.Series) -> pd.Series:
        given = batch.notna().to_numpy()
        out = np.full(len(batch), None, object)
        for at, vector in zip(np.flatnonzero(given), hash_vectors([prefix + t for t in batch[given]], dim)):
            out[at] = vector
        return pd.Series(out, dtype=object)

    return embed_batch(text)
