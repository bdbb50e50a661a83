"""Queries of the operators in this subpackage, by name; SQL where the rows can be had in SQL as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import encoding, language, linkage, mixture, names, packing, scanned, splitting, subjects
from lodeline.runtime import table


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(table(spark, sf_dir, "publication_authors"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(p1_entities(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "retrieval_results"), "result_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("chunk_index = 0").select("result_id").distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "retrieval_results": (table(spark, sf_dir, "retrieval_results"), "result_id", "text"),
        "parsed_tables": (table(spark, sf_dir, "parsed_tables"), "table_id", "text"),
    }
    return scanned.repair(tables, {"parsed_tables"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_repaired(spark, sf_dir).select("table_name", "record_id").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair(table(spark, sf_dir, "retrieval_results"), "result_id", ("text", "title"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repaired(spark, sf_dir).select("result_id", "field_name").distinct()


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "publications"), table(spark, sf_dir, "open_access_results")
    return linkage.link(left, right, ("publication_id", "title", "doi", "year"), ("oa_id", "title", "doi", "year"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("publication_id", "oa_id").distinct()


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "publications"), "publication_id", "language", "abstract", "title")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(p7_segments(spark, sf_dir)).select("publication_id", F.col("language").alias("language_code")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of every container, and how far the running shares of its task are from the sources' shares when it is closed, at the worst source, in containers."""
    return packing.windows(p8_containers(spark, sf_dir))


def p8_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers whose proportions are the shares of mix_targets, as far as the listed sources' documents go; the others come last."""
    goal = {r["source"]: r["target_share"] for r in table(spark, sf_dir, "mix_targets").groupBy("source").agg(F.max("target_share").alias("target_share")).collect()}  # a row for each listed source
    return packing.pack(table(spark, sf_dir, "documents"), targets=goal)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_pieces, p3_found, p3_repaired, p5_found, p5_repaired, p6_found, p6_matches, p7_found, p7_segments, p8_containers, p8_fill, p8_targeted, p9_mixture, p9_shares, p10_found, p10_subjects)}

SQL: dict[str, str] = {"p2_found": "SELECT DISTINCT result_id FROM retrieval_results WHERE length(text) > 3500"}
