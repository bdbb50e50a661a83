"""Quality of extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import quality as Q
from lodeline.plans.text import norm
from lodeline.runtime import table

RULES = (
    ("error", "no_title", "title IS NULL OR title = ''"),
    ("error", "bad_confidence", "confidence NOT BETWEEN 0 AND 1"),
    ("warning", "no_doi", "doi IS NULL OR doi = ''"),
    ("warning", "no_year", "year IS NULL"),
    ("warning", "no_abstract", "abstract IS NULL OR abstract = ''"),
    ("info", "late_load", None),
)


def _publication_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.datediff("loaded_at", "extracted_at") > 7
    rules = [(s, k, F.coalesce(F.expr(c), F.lit(False)) if c else F.coalesce(late, F.lit(False))) for s, k, c in RULES]
    return Q.issues(table(spark, sf_dir, "publications"), "publication_id", rules)


def d7_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publication_issues(spark, sf_dir)


def a11_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tally(_publication_issues(spark, sf_dir), ["blocker", "error", "warning", "info"])


def d8_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each table to publications, and how many of them lead nowhere."""
    p = table(spark, sf_dir, "publications").select("doc_id", F.lit(True).alias("known")).distinct()
    parts = []
    for t in ("publication_authors", "procedure_summaries", "retrieval_results", "parsed_tables"):
        r = table(spark, sf_dir, t).select("doc_id").join(p, "doc_id", "left")
        parts.append(r.agg(F.count("*").alias("refs"), F.count_if(F.col("known").isNull()).alias("broken")).select(F.lit(t).alias("table_name"), "refs", "broken"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def d9_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sole authors without any mark, and cards without evidence of a process."""
    a = table(spark, sf_dir, "publication_authors")
    alone = a.groupBy("publication_id").agg(F.count_distinct("author_id").alias("n"), F.max(F.coalesce("email", "orcid")).alias("mark")).where("n = 1 and mark is null").select(F.lit("unmarked_author").alias("issue"), F.col("publication_id").alias("id"))
    weak = table(spark, sf_dir, "procedure_summaries").where("confidence < 0.5 and (steps is null or size(steps) < 2)").select(F.lit("weak_procedure"), "procedure_summary_id").distinct()
    return alone.union(weak)


def d10_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications").select(F.lit("publications").alias("t"), "extraction_status").unionAll(table(spark, sf_dir, "procedure_summaries").select(F.lit("procedures"), "extraction_status"))
    return p.groupBy("t", "extraction_status").agg(F.count("*").alias("n"))


def d11_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications")
    full = lambda c: F.try_divide(F.count_if(~T.is_empty(F.col(c), "string")), F.count(F.lit(1)))
    f = p.agg(full("title").alias("title"), full("abstract").alias("abstract"), full("doi").alias("doi"), F.try_divide(F.count_if(F.coalesce(F.lower("language"), F.lit("")).isin("", "unknown", "und", "n/a")), F.count(F.lit(1))).alias("unknown"), F.count_if(F.col("extraction_status") == "failed").alias("failed"))
    return Q.gate(f, {"titles": F.col("title") >= 0.98, "abstracts": F.col("abstract") >= 0.9, "dois": F.col("doi") >= 0.98, "languages": F.col("unknown") <= 0.2, "no_failed": F.col("failed") == 0})


def d12_summary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose key points are too short, or hardly touch the card's own steps."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    a, b = F.array_distinct(T.words(F.col("key_points"))), F.array_distinct(T.words(F.array_join(F.transform("steps", lambda s: s["description"]), " ")))
    x = p.select("procedure_summary_id", F.length("key_points").alias("n"), F.size(a).alias("words"), F.size(F.array_intersect(a, b)).alias("shared"))
    rules = [("warning", "short", F.col("n") < 80), ("warning", "no_overlap", (F.col("words") >= 10) & (F.col("shared") / F.col("words") < 0.12))]
    return Q.issues(x, "procedure_summary_id", [(s, k, F.coalesce(c, F.lit(False))) for s, k, c in rules])


def d14_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vectors fit what an index of them would promise."""
    e = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.count_distinct("vec_id").alias("ids"))
    return Q.gate(e, {"dimension": (F.col("least") == 64) & (F.col("most") == 64), "enough": F.col("n") >= 100, "unique": F.col("ids") == F.col("n")})


def q8_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each work, the open copy if there is one, else the best status by rank."""
    o = table(spark, sf_dir, "open_access_results").where("title is not null")
    rank = F.when(F.col("open_access"), 0).when(F.col("access_status") == "metadata_only", 1).when(F.col("access_status") == "paywalled", 2).otherwise(3)
    g = o.groupBy(T.normalise(F.col("title")).alias("work")).agg(F.min(F.struct(rank.alias("r"), "source", "oa_id")).alias("x"), F.count("*").alias("copies"))
    return g.select("work", F.col("x.oa_id").alias("oa_id"), F.col("x.r").cast("bigint").alias("rank"), "copies")


def q11_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comparison row for each card: first value at hand for each field."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return p.select("procedure_summary_id", F.coalesce(F.nullif("material_name", F.lit("")), first("materials"), F.lit("unknown")).alias("material"), F.coalesce(F.nullif("synthesis_or_process_method", F.lit("")), first("processes"), F.lit("unknown")).alias("method"), F.coalesce(F.nullif("scale", F.lit("")), F.lit("unknown")).alias("scale"))


def q12_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures by material and scale, with the share of the material."""
    r = q11_rows(spark, sf_dir).groupBy("material").agg(*(F.count_if(F.col("scale") == s).alias(s) for s in ("laboratory", "pilot", "industrial")), F.count("*").alias("total"))
    return r.withColumn("status", F.when((F.col("laboratory") > 0) & (F.col("pilot") > 0), "both").when(F.col("laboratory") > 0, "laboratory_only").when(F.col("pilot") > 0, "pilot_only").otherwise("other"))


def q17_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation numbers of each query's sources in the order of first mention."""
    r = table(spark, sf_dir, "retrieval_results").select("query_id", "hit_rank", "result_id", "source_path")
    first = r.groupBy("query_id", "source_path").agg(F.min(F.struct("hit_rank", "result_id")).alias("at"))
    return first.select("query_id", "source_path", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("bigint").alias("number"))


def m4_missing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of source and language that the corpus lacks; both lists are small sets of codes."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    grid = d.select("source").distinct().crossJoin(d.select("lang").distinct())
    return grid.join(d.select("source", "lang").distinct(), ["source", "lang"], "left_anti")


QUERIES = {f.__name__: f for f in (d7_required_fields, a11_issue_counts, d8_references, d9_suspicious, d10_status, d11_gate, d12_summary_audit, d14_manifest, q8_resolved, q11_rows, q12_matrix, q17_citations, m4_missing_grid)}

_ISSUES = " UNION ALL ".join(f"SELECT publication_id, '{s}' AS severity, '{k}' AS code FROM publications WHERE {c or 'date_diff(\'day\', extracted_at, loaded_at) > 7'}" for s, k, c in RULES)
_UNK = "count(*) FILTER (WHERE coalesce(lower(language), '') IN ('', 'unknown', 'und', 'n/a'))::DOUBLE / count(*)"
_ONE = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1)"


def _w(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({norm(x)}, '[\p{{L}}\p{{N}}]+'))"


_ROWS = f"""{_ONE}, r AS (SELECT procedure_summary_id, coalesce(nullif(material_name, ''), materials[1], 'unknown') AS material, coalesce(nullif(synthesis_or_process_method, ''), processes[1], 'unknown') AS method, coalesce(nullif(scale, ''), 'unknown') AS scale FROM p)"""
SQL = {
    "d7_required_fields": _ISSUES,
    "a11_issue_counts": f"WITH i AS ({_ISSUES}), s AS (SELECT unnest(['blocker', 'error', 'warning', 'info']) AS severity) SELECT s.severity, count(code) AS issues, count(DISTINCT code) AS codes FROM s LEFT JOIN i ON s.severity = i.severity GROUP BY ALL",
    "d8_references": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS refs, count(*) FILTER (WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM publications)) AS broken FROM {t}" for t in ("publication_authors", "procedure_summaries", "retrieval_results", "parsed_tables")),
    "d9_suspicious": """SELECT 'unmarked_author' AS issue, publication_id AS id FROM publication_authors GROUP BY publication_id HAVING count(DISTINCT author_id) = 1 AND max(coalesce(email, orcid)) IS NULL
        UNION ALL SELECT DISTINCT 'weak_procedure', procedure_summary_id FROM procedure_summaries WHERE confidence < 0.5 AND (steps IS NULL OR len(steps) < 2)""",
    "d10_status": "SELECT 'publications' AS t, extraction_status, count(*) AS n FROM publications GROUP BY ALL UNION ALL SELECT 'procedures', extraction_status, count(*) FROM procedure_summaries GROUP BY ALL",
    "d11_gate": f"""WITH f AS (SELECT count(*) FILTER (WHERE title <> '')::DOUBLE / count(*) AS t, count(*) FILTER (WHERE abstract <> '')::DOUBLE / count(*) AS a, count(*) FILTER (WHERE doi <> '')::DOUBLE / count(*) AS d, {_UNK} AS u, count(*) FILTER (WHERE extraction_status = 'failed') AS x FROM publications)
        SELECT 'titles' AS "check", t >= 0.98 AS passed FROM f UNION ALL SELECT 'abstracts', a >= 0.9 FROM f UNION ALL SELECT 'dois', d >= 0.98 FROM f UNION ALL SELECT 'languages', u <= 0.2 FROM f UNION ALL SELECT 'no_failed', x = 0 FROM f""",
    "d12_summary_audit": f"""WITH {_ONE}, w AS (SELECT procedure_summary_id, length(key_points) AS n, {_w('key_points')} AS a, {_w("array_to_string(list_transform(steps, lambda s: s.description), ' ')")} AS b FROM p)
        SELECT procedure_summary_id, 'warning' AS severity, 'short' AS code FROM w WHERE n < 80 UNION ALL SELECT procedure_summary_id, 'warning', 'no_overlap' FROM w WHERE len(a) >= 10 AND len(list_intersect(a, b)) / len(a) < 0.12""",
    "d14_manifest": """WITH e AS (SELECT count(*) AS n, min(len(embedding)) AS a, max(len(embedding)) AS b, count(DISTINCT vec_id) AS i FROM embeddings) SELECT 'dimension' AS "check", a = 64 AND b = 64 AS passed FROM e UNION ALL SELECT 'enough', n >= 100 FROM e UNION ALL SELECT 'unique', i = n FROM e""",
    "q8_resolved": f"""WITH o AS (SELECT {norm('title')} AS work, oa_id, CASE WHEN open_access THEN 0 WHEN access_status = 'metadata_only' THEN 1 WHEN access_status = 'paywalled' THEN 2 ELSE 3 END AS r, source FROM open_access_results WHERE title IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY r, source, oa_id) AS n, count(*) OVER (PARTITION BY work) AS copies FROM o) SELECT work, oa_id, r::BIGINT AS rank, copies FROM k WHERE n = 1""",
    "q11_rows": f"WITH {_ROWS} SELECT * FROM r",
    "q12_matrix": f"""WITH {_ROWS}, c AS (SELECT material, count(*) FILTER (WHERE scale = 'laboratory') AS laboratory, count(*) FILTER (WHERE scale = 'pilot') AS pilot, count(*) FILTER (WHERE scale = 'industrial') AS industrial, count(*) AS total FROM r GROUP BY ALL)
        SELECT *, CASE WHEN laboratory > 0 AND pilot > 0 THEN 'both' WHEN laboratory > 0 THEN 'laboratory_only' WHEN pilot > 0 THEN 'pilot_only' ELSE 'other' END AS status FROM c""",
    "q17_citations": "WITH f AS (SELECT query_id, source_path, hit_rank, result_id, row_number() OVER (PARTITION BY query_id, source_path ORDER BY hit_rank, result_id) AS k FROM retrieval_results) SELECT query_id, source_path, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, result_id) AS number FROM f WHERE k = 1",
    "m4_missing_grid": "SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents WHERE lang IS NOT NULL) s, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = l.lang)",
}
