"""Readers and writers of the interchange formats.

Missing paths read as empty tables; broken records are rows with their error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodeline.sources.documents import parse


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """Rows of a file of JSON lines; blank and broken lines are left out, a missing file is empty."""
    s = S._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], s)
    return spark.read.schema(s).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """Rows with ``_error``: the raw text of a line that isn't an object of the schema, else null. Blank lines are skipped."""
    s = S._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = S.StructType([*s.fields, S.StructField("_error", S.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], wide)
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", s, {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)) & F.ltrim("value").startswith("{")
    return lines.select(F.when(ok, row).alias("r"), F.when(~ok, F.col("value")).alias("_error")).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in s.fields), "_error")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with sorted columns and a header; nested columns as JSON."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (S.ArrayType, S.MapType, S.StructType))}
    df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in sorted(df.columns))).write.mode("overwrite").option("header", True).csv(path)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells) of CSV files of any width, every cell a string; the header is row 1.

    Row numbers count within a file, so files are read whole; a file of cells is small by nature.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        for b in batches:
            for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                got = [(p, i, x) for i, x in enumerate(csv.reader(io.StringIO(c.decode("utf-8-sig", "replace"))), 1) if x]
                yield pa.record_batch([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string())))], ["path", "row_no", "cells"])

    return files.mapInArrow(rows, "path string, row_no int, cells array<string>")


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, local_path, extension, parser, status, title, text, n_tables, error) of every file under ``path``.

    The parser goes by content first, then by suffix; what can't be read is a row with its status and error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["local_path", "extension", "parser", "status", "title", "text", "n_tables", "error"]
        for b in batches:
            rows = [(p, *parse(p, c)) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist())]
            types = [pa.string()] * 6 + [pa.int32(), pa.string()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    out = files.mapInArrow(run, "local_path string, extension string, parser string, status string, title string, text string, n_tables int, error string")
    return out.select(F.substring(F.sha1("local_path"), 1, 16).alias("doc_id"), "*")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the changed keys replaced by those of ``changes``."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def head_lines(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(line_no, value) of the first ``most`` physical lines of one file; numbers follow the file, blank lines count."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.slice(F.split("value", "\\r?\\n"), 1, most)).alias("p", "value")).select((F.col("p") + 1).alias("line_no"), "value")


def table_summary(rows: DataFrame) -> DataFrame:
    """(path, columns, rows, header) of tables read by :func:`read_csv_rows`; the header is not counted as a row."""
    g = rows.groupBy("path").agg(F.max(F.size("cells")).alias("columns"), F.greatest(F.count("*") - 1, F.lit(0)).alias("rows"), F.min_by("cells", "row_no").alias("header"))
    return g.select("path", "columns", "rows", F.array_join("header", " | ").alias("header"))


def preview(rows: DataFrame, most_rows: int = 80, most_columns: int = 50) -> DataFrame:
    """First rows and columns of every table, cells trimmed, and whether something was left out."""
    cut = (F.size("cells") > most_columns).alias("truncated")
    return rows.where(F.col("row_no") <= most_rows).select("path", "row_no", F.transform(F.slice("cells", 1, most_columns), lambda x: F.trim(x)).alias("cells"), cut)


SHEETS = "struct<sheets:array<struct<sheet_index:string,sheet_name:string,rows:string,columns:string,csv_path:string>>>"


def explode_sheets(documents: DataFrame, id_col: str = "doc_id", json_col: str = "metadata_json", root: str = "data/parsed/spreadsheets_csv/") -> DataFrame:
    """(doc_id, sheet_index, sheet_name, rows, columns, csv_path) of the sheets in a JSON column.

    Broken JSON and documents without an id give nothing; counts that aren't numbers are 0; paths of any
    system are cut after the root.
    """
    d = documents.where(F.coalesce(F.col(id_col), F.lit("")) != "").select(F.col(id_col).alias("doc_id"), F.explode(F.from_json(json_col, SHEETS)["sheets"]).alias("s"))
    num = lambda c: F.coalesce(F.expr(f"try_cast(s.{c} as int)"), F.lit(0)).alias(c)
    path = F.regexp_replace(F.replace("s.csv_path", F.lit("\\"), F.lit("/")), f"^.*?{root}", "")
    return d.where("s is not null").select("doc_id", num("sheet_index"), F.col("s.sheet_name").alias("sheet_name"), num("rows"), num("columns"), F.coalesce(path, F.lit("")).alias("csv_path"))
