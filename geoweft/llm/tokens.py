"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the vocabulary used unless another is named.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's texts are split before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space in a row from which texts are split by another matcher.
LONG_BLANK = 5_000


@cache
def encoding(path: str):
    """The encoder of a rank file, one per Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _long_blank():
    import re

    return re.compile(rf"\s{{{LONG_BLANK}}}")


@cache
def _pieces():
    import regex

    return regex.compile(PATTERN)


def token_count(encoder, text: str) -> int:
    """Tokens of one whole text, of any length.

    The encoder's own matcher runs out of stack in a long stretch of white space; a text that has one is split by the same
    pattern with another matcher, and each piece is encoded.
    """
    if len(text) >= LONG_BLANK and _long_blank().search(text):
        return sum(len(encoder._encode_single_piece(p)) for p in _pieces().findall(text))
    return len(encoder.encode_ordinary(text))


def count_tokens(text: Column, vocabulary: str = VOCABULARY, folder: str = VOCABULARIES) -> Column:
    """Tokens of each whole text; null for null, 0 for an empty one."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("long")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoding(path)
        for texts in batches:
            yield pd.Series([None if t is None else token_count(encoder, t) for t in texts], dtype="Int64")

    return sizes(text)
