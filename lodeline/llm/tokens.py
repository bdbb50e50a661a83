"""Token counts by a public tokenizer; its folder is a parameter and its files are never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once in a process."""
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(df: DataFrame, text_col: str, keep: dict[str, str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` (new name: column) with ``n_tokens``; null texts count 0."""
    base = df.select(*(col(c).alias(n) for n, c in keep.items()), F.coalesce(col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b["__text"].to_pylist()]
            names = [x for x in b.schema.names if x != "__text"]
            yield pa.record_batch([*(b[x] for x in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return base.mapInArrow(count, f"{schema}, n_tokens bigint")
