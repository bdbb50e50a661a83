"""Connectors to outside services as a data source: ``spark.read.format("lodeline_records")``.

A connector is a function from a request to records. Here they read recorded answers from a folder, one JSON
file for each request; a live one only replaces ``fetch``. A source that fails gives a row with its error.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, position int, title string, doi string, year int, venue string, abstract string, error string"


def fetch(folder: str, name: str) -> object:
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return json.load(f)


def _first(x: object) -> object:
    return x[0] if isinstance(x, list) and x else None if isinstance(x, list) else x


def abstract_of(index: dict[str, list[int]] | None) -> str | None:
    """Text of an inverted index (word to positions)."""
    if not index:
        return None
    return " ".join(w for _, w in sorted((p, w) for w, places in index.items() for p in places))


def record(item: dict) -> dict:
    """One record of any service in the common shape: year from the first field that has one, the DOI bare."""
    year = None
    for k in ("year", "publication_year", "published", "issued", "date"):
        v = item.get(k)
        if isinstance(v, dict):
            v = _first(_first(v.get("date-parts")))
        digits = "".join(ch for ch in str(v or "")[:4] if ch.isdigit())
        if len(digits) == 4:
            year = int(digits)
            break
    doi = str(item.get("doi") or item.get("DOI") or "").lower()
    at = doi.find("10.")
    abstract = item.get("abstract") or abstract_of(item.get("abstract_inverted_index"))
    return {"title": _first(item.get("title") or item.get("display_name")), "doi": doi[at:].rstrip(".,;") if at >= 0 else None, "year": year, "venue": _first(item.get("venue") or item.get("container-title")), "abstract": abstract}


def items(answer: object) -> list[dict]:
    """The list of records in an answer, however deep it lies."""
    if isinstance(answer, list):
        return [x for x in answer if isinstance(x, dict)]
    if isinstance(answer, dict):
        for k in ("items", "results", "data", "message", "hits", "resultList", "result"):
            if k in answer:
                return items(answer[k])
        return [answer]
    return []


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Part(x) for x in sorted(os.listdir(self.folder)) if x.endswith(".json")] or [_Part("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.value
        if not name:
            return
        source = name.removesuffix(".json")
        try:
            for i, x in enumerate(items(fetch(self.folder, name))):
                r = record(x)
                yield source, i, r["title"], r["doi"], r["year"], r["venue"], r["abstract"], None
        except Exception as e:  # one source's failure leaves the others
            yield source, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodeline_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)
