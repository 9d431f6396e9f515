"""Text sizes in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    """Number of tokens; 0 for a null or empty text. Lone surrogates count as replacement characters."""
    return len(encoder(vocabulary).encode_ordinary(text)) if text else 0


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """``count_tokens`` on a column, in Arrow batches; each Python worker loads the vocabulary once."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(x)) if x else 0 for x in s], dtype="int64")

    return run(text)
