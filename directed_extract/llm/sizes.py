"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file: one line for each token, its bytes in base64 and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str, words: str = WORDS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("documents", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, words: str = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(<key>, <keep>, tokens)`` of every text; NULL and empty texts have none. ``path`` must be readable by every worker.

    Strings that look like special tokens are ordinary text. A worker loads the vocabulary once for each task.
    """
    named = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in named) + ", tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, words)
        for b in batches:
            yield b[named].assign(tokens=[len(e.encode_ordinary(t)) if t else 0 for t in b["_text"]])

    return df.select(*[F.col(f"`{c}`") for c in named], F.col(f"`{text}`").alias("_text")).mapInPandas(count, schema)
