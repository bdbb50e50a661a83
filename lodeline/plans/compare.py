"""Comparison of records and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import search as S
from lodeline.plans.text import norm
from lodeline.runtime import table


def l2_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words of a phrase one after the other."""
    return S.phrase(table(spark, sf_dir, "documents"), "doc_id", "text", "ball-mill circuit").withColumnRenamed("row_id", "doc_id")


def x11_extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a chunk promises for extraction: words of the field, numbers with units, an early place."""
    r = table(spark, sf_dir, "retrieval_results")
    units = F.least(F.size(F.regexp_extract_all("text", F.lit(T.NUMBER_UNIT), F.lit(0))), F.lit(12))
    words = T.once(F.lower("text"), lambda t: sum((t.contains(w).cast("int") for w in ("leach", "flotation", "выщелачив", "флотац", "slag", "шлак")), F.lit(0)))
    return r.select("result_id", T.micro(words + units * 1.8 + F.when(F.coalesce("chunk_index", F.lit(99)) <= 2, 1.5).otherwise(0.0)).alias("score"))


def x20_row_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a card as a row of a comparison: confidence, evidence, numbers and conditions, at most 10."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    s = F.col("confidence") * 5 + F.least(n("steps"), F.lit(4)) * 0.8 + F.least(n("process_parameters"), F.lit(4)) * 0.5 + F.when(n("conditions") > 0, 0.5).otherwise(0.0)
    return p.select("procedure_summary_id", T.micro(F.least(F.lit(10.0), s)).alias("score"))


def x21_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a focus: blocked words out, wanted words raise the row."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    s = T.once(F.lower(F.concat_ws(" ", "material_name", "synthesis_or_process_method", "key_points")), lambda t: F.struct(sum((t.contains(w).cast("int") for w in ("ore", "nickel", "руд", "никел")), F.lit(0)).alias("hits"), (t.contains("court") | t.contains("суд")).alias("blocked")))
    return p.select("procedure_summary_id", s.alias("s")).where("not s.blocked and s.hits > 0").select("procedure_summary_id", F.col("s.hits").cast("bigint").alias("hits"), T.micro(F.least(F.lit(2.5), F.col("s.hits") * 0.45)).alias("boost"))


def d2_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source packages within 600 characters: the abstract is trimmed before the title is."""
    p = table(spark, sf_dir, "publications").dropDuplicates(["publication_id"])
    title = T.compact(F.coalesce("title", F.lit("")), 200)
    rest = F.greatest(F.lit(40), F.lit(600) - F.length(title))
    body = T.collapse(F.coalesce("abstract", F.lit("")))
    cut = F.when(F.length(body) > rest, F.concat(F.substring(body, F.lit(1), rest - 3), F.lit("..."))).otherwise(body)
    return p.select("publication_id", F.length(F.concat(title, cut)).cast("bigint").alias("chars"), (F.length(body) > rest).alias("trimmed"))


def d3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the fields of a later extraction laid over them where those aren't empty; ids stay."""
    p = table(spark, sf_dir, "publications")
    g = p.groupBy("publication_id").agg(*(F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("extracted_at"))).alias(c) for c in ("doi", "year", "venue_name")), F.max("extracted_at").alias("extracted_at"))
    return g


def q10_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods compared: cards, best confidence, how many materials, and what none of their cards says."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    m = T.normalise(F.coalesce(F.nullif("synthesis_or_process_method", F.lit("")), F.lit("unknown")))
    g = p.groupBy(m.alias("method")).agg(F.count("*").alias("cards"), F.max("confidence").alias("best"), F.count_distinct("material_name").alias("materials"), F.count_if(F.size("conditions") > 0).alias("with_conditions"), F.count_if(F.size("process_parameters") > 0).alias("with_parameters"))
    gap = F.when(F.col("with_conditions") == 0, "conditions").when(F.col("with_parameters") == 0, "parameters").otherwise("none")
    return g.select("method", "cards", "best", "materials", gap.alias("gap"))


QUERIES = {f.__name__: f for f in (l2_phrase, x11_extraction_score, x20_row_score, x21_focus, d2_packages, d3_merged, q10_methods)}

_MICRO = "CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"
_ONE = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1)"
_C = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
SQL = {
    "l2_phrase": rf"""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all({norm('text')}, '[\p{{L}}\p{{N}}]+'), '  ') || ' ' AS t FROM documents), h AS (SELECT doc_id, ((length(t) - length(replace(t, ' ball  mill  circuit ', ''))) // 21)::BIGINT AS hits FROM w) SELECT * FROM h WHERE hits > 0""",
    "x11_extraction_score": rf"""SELECT result_id, {_MICRO.format(x="len(list_filter(['leach', 'flotation', 'выщелачив', 'флотац', 'slag', 'шлак'], lambda w: contains(lower(text), w))) + least(len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)? ?(?:%|°C|mg/L|mm|m3/h|kt|Mt|h|s)')), 12) * 1.8::DOUBLE + CASE WHEN coalesce(chunk_index, 99) <= 2 THEN 1.5 ELSE 0.0 END")} AS score FROM retrieval_results""",
    "x20_row_score": f"WITH {_ONE} SELECT procedure_summary_id, {_MICRO.format(x='least(10.0::DOUBLE, confidence * 5 + least(coalesce(len(steps), 0), 4) * 0.8::DOUBLE + least(coalesce(len(process_parameters), 0), 4) * 0.5::DOUBLE + CASE WHEN len(conditions) > 0 THEN 0.5 ELSE 0.0 END)')} AS score FROM p",
    "x21_focus": f"""WITH {_ONE}, t AS (SELECT procedure_summary_id, lower(concat_ws(' ', material_name, synthesis_or_process_method, key_points)) AS t FROM p), h AS (SELECT procedure_summary_id, len(list_filter(['ore', 'nickel', 'руд', 'никел'], lambda w: contains(t, w)))::BIGINT AS hits FROM t WHERE NOT (contains(t, 'court') OR contains(t, 'суд')))
        SELECT procedure_summary_id, hits, {_MICRO.format(x='least(2.5::DOUBLE, hits * 0.45::DOUBLE)')} AS boost FROM h WHERE hits > 0""",
    "d2_packages": rf"""WITH p AS (SELECT publication_id, any_value({_C.format(x="coalesce(title, '')")}) AS t, coalesce(any_value({_C.format(x="coalesce(abstract, '')")}), '') AS b FROM publications GROUP BY ALL), c AS (SELECT publication_id, CASE WHEN length(t) > 200 THEN regexp_replace(substr(t, 1, 197), '\s+$', '') || '...' ELSE t END AS t, b FROM p),
        r AS (SELECT *, greatest(40, 600 - length(t)) AS rest FROM c) SELECT publication_id, (length(t) + least(length(b), rest))::BIGINT AS chars, length(b) > rest AS trimmed FROM r""",
    "d3_merged": "SELECT publication_id, arg_max(doi, extracted_at) FILTER (WHERE doi <> '') AS doi, arg_max(year, extracted_at) FILTER (WHERE year IS NOT NULL) AS year, arg_max(venue_name, extracted_at) FILTER (WHERE venue_name <> '') AS venue_name, max(extracted_at) AS extracted_at FROM publications GROUP BY ALL",
    "q10_methods": f"""WITH {_ONE}, g AS (SELECT {norm("coalesce(nullif(synthesis_or_process_method, ''), 'unknown')")} AS method, count(*) AS cards, max(confidence) AS best, count(DISTINCT material_name) AS materials, count(*) FILTER (WHERE len(conditions) > 0) AS c, count(*) FILTER (WHERE len(process_parameters) > 0) AS q FROM p GROUP BY ALL)
        SELECT method, cards, best, materials, CASE WHEN c = 0 THEN 'conditions' WHEN q = 0 THEN 'parameters' ELSE 'none' END AS gap FROM g""",
}
