"""Embeddings that need no model, and the protocol for those that do.

Null and empty texts give the zero vector; a provider's failure is a row with its error.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.runtime import col

WORD = re.compile(r"[\w.+#%-]+")
GRAM_WEIGHT = 0.35


class Refused(Exception):
    """The service refuses the texts for good; they are not sent again as they are."""


class TooLong(Refused):
    """A text is over the service's limit; it is sent again shortened."""


class Later(Exception):
    """The service asks to wait ``seconds`` first."""

    def __init__(self, seconds: float):
        super().__init__(f"asked to wait {seconds} s")
        self.seconds = seconds


class Provider(Protocol):
    """Embeds a batch of texts; made anew in every task by a function that can be pickled. Failures that another try can't mend are :class:`Refused`, waits that a service asks for :class:`Later`."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def _features(word: str) -> list[tuple[int, float]]:
    """(64-bit hash, signed weight) of a word and, from five letters on, of its 3-grams at a lower weight; the hash is little-endian, its top bit means minus."""
    parts = {word: 1.0}
    grams = [word[i : i + 3] for i in range(len(word) - 2)] if len(word) >= 5 else []
    out = []
    for x, weight in [*parts.items(), *((g, GRAM_WEIGHT) for g in grams)]:
        (h,) = struct.unpack("<Q", hashlib.blake2b(x.encode(), digest_size=8).digest())
        out.append((h, math.copysign(weight * math.log1p(len(x)), -1 if h >> 63 else 1)))
    return out


def hash_vectors(texts: list[str], dim: int) -> np.ndarray:
    """A row of length 1 for each text (zero for one without words) by signed feature hashing; every distinct word of the batch is hashed once."""
    words = [WORD.findall(t.lower().replace("ё", "е")) for t in texts]
    of = {w: _features(w) for w in {w for x in words for w in x}}
    rows = [(i, h % dim, v) for i, x in enumerate(words) for w in x for h, v in of[w]]
    out = np.zeros((len(texts), dim))
    if rows:
        i, at, v = (np.array(c) for c in zip(*rows))
        out = np.bincount(i * dim + at.astype(np.int64), weights=v, minlength=out.size).reshape(out.shape)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def hashed(df: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """(id, embedding) by :func:`hash_vectors`."""
    return provided(df, id_col, text_col, lambda: lambda texts: hash_vectors(texts, dim), batch=1024, retries=0).select(col(id_col), "embedding")


def provided(df: DataFrame, id_col: str, text_col: str, make, batch: int = 64, retries: int = 2, wait: float = 0.5, most_wait: float = 60.0) -> DataFrame:
    """(id, embedding, error) by a provider in batches.

    Between tries the wait doubles, or is what the service asks for, up to ``most_wait``. A batch that keeps
    failing or is refused is tried text by text; a text that is too long is halved until it is taken.
    """
    base = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def attempt(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            why = ""
            for k in range(retries + 1):
                try:
                    return [(list(map(float, v)), None) for v in call(texts)]
                except TooLong as e:
                    if len(texts) == 1 and len(texts[0]) > 1:
                        return attempt([texts[0][: len(texts[0]) // 2]])
                    why = f"{type(e).__name__}: {e}"[:200]
                    break
                except Refused as e:
                    why = f"{type(e).__name__}: {e}"[:200]
                    break
                except Exception as e:  # an error is a row, not a failed job
                    why = f"{type(e).__name__}: {e}"[:200]
                    if k < retries:
                        time.sleep(min(most_wait, e.seconds if isinstance(e, Later) else wait * 2**k))
            return [x for t in texts for x in attempt([t])] if len(texts) > 1 else [(None, why)]

        for b in batches:
            texts = [t or "" for t in b["t"].to_pylist()]
            got = [x for at in range(0, len(texts), batch) for x in attempt(texts[at : at + batch])]
            yield pa.record_batch([b["id"], pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.string())], ["id", "embedding", "error"])

    return base.mapInArrow(run, f"id {kind}, embedding array<double>, error string").withColumnRenamed("id", id_col)
