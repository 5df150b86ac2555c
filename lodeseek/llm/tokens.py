"""Token counts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in slices of about this many characters, cut before white space, so that memory stays flat.
SLICE = 100_000


def default_tokenizer_path() -> str:
    """The vocabulary file where the package ``public_tokenizers`` is installed; elsewhere a path has to be given."""
    try:
        import public_tokenizers
    except ImportError:
        raise ValueError("name a vocabulary file: a .tiktoken rank file or a tokenizers .json file") from None

    return public_tokenizers.path(DEFAULT_TOKENIZER)


@lru_cache(maxsize=4)
def _counter(path: str, pattern: str):
    """A function from text to its number of tokens; made once in each Python worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _slices(text: str):
    start = 0
    while len(text) - start > SLICE:
        cut = text.rfind(" ", start + 1, start + SLICE)
        cut = cut if cut > start else start + SLICE
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_count(text: Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """Number of tokens of ``text`` under the vocabulary at ``path`` (``pattern`` is for rank files, which don't hold
    theirs); 0 for an empty text, null for a null one."""
    path = path or default_tokenizer_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(path, pattern)
        return pd.Series([None if t is None else sum(map(counter, _slices(t))) if t else 0 for t in texts], dtype="Int64")

    return count(text)
