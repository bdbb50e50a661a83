"""Splitting oversized texts at natural boundaries.

Method: balanced targets. The minimum piece count that the limit and the overlap allow is computed, equal
targets are placed, each is snapped to the strongest boundary near it, and the count is raised by one while
any piece would exceed the limit. Piece i+1 starts with the last ``overlap`` characters of piece i.

Edge cases (tests/llm/test_splitting.py): null and empty texts and texts within the limit give no piece; a
text without any boundary is cut at the equal targets; repeated rows are split alike, each for itself; an
empty table gives an empty result; the columns of the input may have any names, as only the named ones are
read. Lengths count code points. A text of N characters is handled in O(N).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col

LIMIT, OVERLAP = 3500, 400
#: Boundaries from strong to weak; a cut lies after the match.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"(?<![\s(«„“][^\W\d_])(?<!\bNo)(?<!\bNr)(?<!\bFig)(?<!\bTab)[.!?…]+[»”\"')\]]*\s+(?=[^\W\d_«„“\"(•·–—]*[^\Wa-zа-яё_]|[«„“•·–—])"),
    re.compile(r"[;:][»”\"')\]]*\s+|\s[—–]\s"),
    re.compile(r",\s+"),
    re.compile(r"\s+"),
)


def _snap(text: str, target: int, low: int, high: int) -> int | None:
    """The strongest boundary in [low, high]; of equals the one nearest to the target, the first on ties; else None."""
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(0, low - 200), min(len(text), high + 200)):
            at = m.end()
            if low <= at <= high and at < len(text) and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best
    return None


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the new part of each piece; the last is the length of the text."""
    n = len(text)
    if n <= limit:
        return [n]
    room = limit - overlap
    count = 1 + -(-(n - limit) // room)
    while True:
        step = (n - overlap) / count  # every piece holds one step and the overlap
        window = max(1, min(int(step / 3), 600))
        out, start, fits = [], 0, True
        for i in range(1, count):
            target = round(overlap + step * i)
            most = start + limit if not out else out[-1] + room
            least = start + overlap + 1 if not out else out[-1] + 1
            high = min(target + window, most)
            if least > high:
                fits = False
                break
            low = max(min(target - window, high), least)
            target = min(max(target, low), high)
            end = _snap(text, target, low, high)
            if end is None and (low > least or high < most):  # no boundary near: any that the limit allows
                end = _snap(text, target, least, min(most, n - 1))
            if end is None:
                end = target
            out.append(end)
            start = end - overlap
        if fits and n - (out[-1] - overlap if out else 0) <= limit:
            return [*out, n]
        count += 1


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces."""
    out, start = [], 0
    for end in cuts(text, limit, overlap):
        out.append((start, end))
        start = max(0, end - overlap)
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str = "text", index_col: str | None = "chunk_index", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit``: (id, source_index, chunk_index, n_pieces, start, end, text).

    ``chunk_index`` counts the pieces of a record from 0; ``source_index`` keeps the record's own index. The
    length test runs in the scan stage, so only oversized texts reach Python; nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    index = col(index_col).cast("int") if index_col else F.lit(None).cast("int")
    long = df.select(col(id_col).alias("id"), index.alias("source_index"), col(text_col).alias("t")).where(F.length("t") > limit)
    kind = long.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, k, len(p), x, y, t[x:y]) for i, s, t in zip(*(b[c].to_pylist() for c in ("id", "source_index", "t"))) for p in [pieces(t, limit, overlap)] for k, (x, y) in enumerate(p)]
            types = [b["id"].type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], [id_col, "source_index", "chunk_index", "n_pieces", "start", "end", "text"])

    return long.mapInArrow(cut, f"`{id_col}` {kind}, source_index int, chunk_index int, n_pieces int, start int, end int, text string")
