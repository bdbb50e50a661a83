"""Joins, aggregations, windows, sorts and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import joins as J
from lodeline.operators.prefix import running_sum
from lodeline.plans.text import norm
from lodeline.runtime import table


def j1_lookup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "retrieval_results").select("result_id", "doc_id")
    p = table(spark, sf_dir, "publications")
    return J.lookup_last(r, p, "doc_id", [F.col("extracted_at"), F.col("confidence")], ["document_kind", "venue_name"])


def j2_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "publication_authors").where("orcid is not null").select("publication_id")
    return table(spark, sf_dir, "publications").join(a, "publication_id", "left_semi").select("publication_id", "extracted_at")


def j3_broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications that no retrieval result refers to, and tables of unknown documents."""
    p = table(spark, sf_dir, "publications").select("doc_id").distinct()
    r, t = table(spark, sf_dir, "retrieval_results").select("doc_id"), table(spark, sf_dir, "parsed_tables").select("doc_id")
    never = p.join(r, "doc_id", "left_anti").select(F.lit("never_retrieved").alias("issue"), "doc_id")
    return never.unionByName(t.join(p, "doc_id", "left_anti").distinct().select(F.lit("unknown_document").alias("issue"), "doc_id"))


def j4_similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a publication and an open-access record whose titles share at least four fifths of their words."""
    a = table(spark, sf_dir, "publications").where("title is not null").select("publication_id", T.words(F.col("title")).alias("w"))
    b = table(spark, sf_dir, "open_access_results").where("title is not null").select("oa_id", T.words(F.col("title")).alias("w"))
    return J.similar_sets(a, b, "publication_id", "oa_id", "w", 0.8).select("publication_id", "oa_id", "shared", T.micro(F.col("jaccard")).alias("jaccard"))


def j4_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "publications").where("title is not null").select("publication_id").distinct()
    return a.join(j4_similar_titles(spark, sf_dir), "publication_id", "left_anti")


def j6_keywords_in_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications").where("abstract is not null and keywords is not null").select("publication_id", F.lower("abstract").alias("a"), F.transform("keywords", F.lower).alias("k")).distinct()
    return J.contained(p, "publication_id", "a", "k", 3).select("publication_id", "term", F.col("place").cast("bigint").alias("place"))


def j9_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source dealt in turn to four readers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "section_kind")
    return J.dealt(d, "section_kind", "doc_id", 4).select("doc_id", F.col("turn").cast("bigint").alias("reader"))


def j10_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation beside the totals of all."""
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.count("*").alias("all_customers"), F.count_distinct("c_mktsegment").alias("segments"))
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.crossJoin(F.broadcast(total))  # one row


def a1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, by language and of all in one pass."""
    d = table(spark, sf_dir, "documents").select("source", F.coalesce("lang", F.lit("-")).alias("lang"))
    g = d.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return g.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "level")


def a2_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    return d.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.floor(F.median("n_chars")).cast("bigint").alias("median_chars"), F.max("n_chars").alias("most"))


def a3_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at the nearest rank of the 95th percentile of each event type, ranks rounded half to even."""
    e = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("m"))
    span = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("m").alias("n"))
    x = e.join(F.broadcast(span), "event_type")  # one row for each event type
    x = x.withColumn("bucket", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 999)).otherwise(0))
    x = running_sum(x, ["event_type"], "bucket", [F.col("value")], "m", "upto")
    rank = F.bround((F.col("n") - 1) * 0.95).cast("bigint") + 1
    return x.where((F.col("upto") >= rank) & (F.col("upto") - F.col("m") < rank)).select("event_type", F.col("value").alias("p95"), "n")


def a4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled rows of each field, in one pass."""
    p = table(spark, sf_dir, "publications")
    fields = {"title": "string", "language": "string", "venue_name": "string", "doi": "string", "abstract": "string", "keywords": "array"}
    one = p.agg(F.count("*").alias("total"), *(F.count_if(~T.is_empty(F.col(c), k)).alias(c) for c, k in fields.items()))
    return one.select("total", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "filled")).select("field", "filled", "total", T.micro(F.try_divide("filled", "total")).alias("ratio"))


def a5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts: the first row stands for its class."""
    r = table(spark, sf_dir, "retrieval_results").select("result_id", F.sha2("text", 256).alias("h"))
    c = r.groupBy("h").agg(F.min("result_id").alias("class_id"), F.count("*").alias("copies"))
    return r.join(c, "h").select("result_id", "class_id", "copies")


def a6_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent keywords of each document kind."""
    k = table(spark, sf_dir, "publications").select("document_kind", F.explode("keywords").alias("keyword"))
    n = k.groupBy("document_kind", "keyword").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("document_kind").orderBy(F.desc("n"), "keyword")).cast("bigint")).where("rank <= 10")


def a7_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications").select(F.lower("extension").alias("extension"), "extraction_status")
    out = p.groupBy("extension").pivot("extraction_status", ["ok", "partial"]).agg(F.count(F.lit(1))).fillna(0)
    return out.join(p.groupBy("extension").agg(F.count("*").alias("total")), "extension")


def a8_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one publication merged: ordered union of equipment, best confidence, first scale that isn't empty."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    g = p.groupBy("publication_id").agg(
        F.array_sort(F.collect_list(F.struct("procedure_summary_id", "equipment"))).alias("x"), F.max("confidence").alias("confidence"),
        F.min_by("scale", F.when(F.coalesce(F.col("scale"), F.lit("")) != "", F.col("procedure_summary_id"))).alias("scale"), F.count("*").alias("cards"),
    )
    return g.select("publication_id", F.array_join(F.slice(F.array_distinct(F.flatten(F.transform("x", lambda s: F.coalesce(s["equipment"], F.array().cast("array<string>"))))), 1, 12), "; ").alias("equipment"), "confidence", "scale", "cards")


def a9_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications extracted twice: the later row counts, and how far its confidence moved."""
    p = table(spark, sf_dir, "publications")
    g = p.groupBy("publication_id").agg(F.count("*").alias("rows"), F.max_by("confidence", "extracted_at").alias("last"), F.min_by("confidence", "extracted_at").alias("first"))
    return g.where("rows > 1").select("publication_id", "rows", "last", T.micro(F.col("last") - F.col("first")).alias("moved"))


def a10_mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter names that come with more than one unit."""
    m = table(spark, sf_dir, "procedure_summaries").select(F.explode("process_parameters").alias("m")).select(F.element_at("m", F.lit("name")).alias("name"), F.nullif(F.trim(F.element_at("m", F.lit("unit"))), F.lit("")).alias("unit"))
    g = m.where("name is not null and unit is not null").groupBy("name").agg(F.count_distinct("unit").alias("units"), F.array_join(F.array_sort(F.collect_set("unit")), "|").alias("spellings"))
    return g.where("units > 1")


def a12_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("bigint").alias("cents"))
    return e.select("event_type", "day", "cents", T.micro(F.col("cents") / F.sum("cents").over(Window.partitionBy("day"))).alias("share"))


def a13_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications").where("year is not null")
    return p.groupBy("source_type").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), (F.max("year") - F.min("year")).alias("span"), T.micro(F.avg("year")).alias("mean_year"))


def a14_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose first hit and whose first three hits mention a word of the best title."""
    r = table(spark, sf_dir, "retrieval_results").select("query_id", "hit_rank", "result_id", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower("text").alias("x"))
    want = r.where("t <> ''").groupBy("query_id").agg(F.min_by("t", F.struct("hit_rank", "result_id")).alias("t")).select("query_id", F.regexp_extract("t", r"([\p{L}]{6,})", 1).alias("word")).where("word <> ''")
    hit = r.join(want, "query_id").select("query_id", "hit_rank", F.col("x").contains(F.col("word")).alias("ok"))
    return hit.groupBy("query_id").agg(F.coalesce(F.bool_or(F.when(F.col("hit_rank") == 1, F.col("ok"))), F.lit(False)).alias("top1"), F.coalesce(F.bool_or(F.when(F.col("hit_rank") <= 3, F.col("ok"))), F.lit(False)).alias("top3"))


def w2_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("r")).where("r <= 3")


def w3_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("publication_id").orderBy(F.desc("extracted_at"), F.desc("confidence"))
    return table(spark, sf_dir, "publications").withColumn("r", F.row_number().over(w)).where("r = 1").select("publication_id", "confidence", "extraction_status")


def w4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query that fit a budget of 4 000 characters in the order of rank, up to the first that doesn't."""
    w = Window.partitionBy("query_id").orderBy("hit_rank", "result_id").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf_dir, "retrieval_results").select("query_id", "result_id", "hit_rank", F.sum(F.length("text") + 2).over(w).cast("bigint").alias("used"))
    return r.where(F.col("used") - 2 <= 4000).select("query_id", "result_id", "used")


def w5_route_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("query_id", "source_type").orderBy(F.desc("score"), "result_id")
    return table(spark, sf_dir, "retrieval_results").select("query_id", "source_type", "result_id", F.row_number().over(w).cast("bigint").alias("r")).where("r <= 5")


def w6_running_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count and size of each document's tables, and whether they stay under both caps."""
    w = Window.partitionBy("doc_id").orderBy("table_id").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf_dir, "parsed_tables").select("doc_id", "table_id", F.count("*").over(w).alias("n"), F.sum(F.octet_length("text")).over(w).cast("bigint").alias("bytes"))
    return t.select("doc_id", "table_id", "n", "bytes", F.when((F.col("n") <= 20) & (F.col("bytes") <= 2500), "included").otherwise("skipped").alias("status"))


def w7_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_click"), F.count("*").alias("clicks"))


def o2_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first orders by urgency, then value."""
    weight = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(weight, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


def o4_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation and venue names, each once, with where it was seen first."""
    a = table(spark, sf_dir, "publication_authors").where("role = 'organization'").select(F.col("raw_name").alias("name"), F.lit(1).alias("src"))
    b = table(spark, sf_dir, "publications").where("venue_name is not null").select(F.col("venue_name").alias("name"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("name").agg(F.min("src").cast("bigint").alias("first_seen"))


def o5_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a card's key points its steps cover."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    a = F.array_distinct(T.words(F.col("key_points")))
    b = F.array_distinct(T.words(F.array_join(F.transform("steps", lambda s: s["description"]), " ")))
    return p.select("procedure_summary_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("shared"), F.size(F.array_except(a, b)).cast("bigint").alias("only_points"), F.size(F.array_union(a, b)).cast("bigint").alias("all_words"))


def o6_positive_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that mention a pH of each query, or all of its hits where none does."""
    r = table(spark, sf_dir, "retrieval_results").select("query_id", "result_id", F.col("text").contains("pH").cast("int").alias("s"))
    return r.withColumn("m", F.max("s").over(Window.partitionBy("query_id"))).where("s > 0 or m = 0").select("query_id", "result_id")


def o7_filter_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open records of each source and year, or all of the year where fewer than three are open."""
    o = table(spark, sf_dir, "open_access_results").select("source", F.coalesce("year", F.lit("")).alias("year"), "oa_id", F.coalesce("open_access", F.lit(False)).alias("open"))
    few = o.groupBy("source", "year").agg(F.count_if("open").alias("n")).where("n < 3").select("source", "year", F.lit(True).alias("few"))
    return o.join(few, ["source", "year"], "left").where("open or few").select("source", "year", "oa_id")


def o8_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of a hundred documents."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("17:"), F.col("doc_id").cast("string")), 256)).limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        j1_lookup_last, j2_semi, j3_broken_refs, j4_similar_titles, j4_left_only, j6_keywords_in_abstract, j9_dealt, j10_augmented, a1_counts, a2_lengths, a3_nearest_rank, a4_coverage, a5_duplicates, a6_top_keywords, a7_pivot, a8_merged,
        a9_last_wins, a10_mixed_units, a12_share, a13_spans, a14_evaluation, w2_top3, w3_latest, w4_budget, w5_route_cap, w6_running_caps, w7_last_event, o2_multi_key, o4_union_distinct, o5_overlap, o6_positive_or_all, o7_filter_or_fallback, o8_hash_sample,
    )
}

_MICRO = "CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"


def _w(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({norm(x)}, '[\p{{L}}\p{{N}}]+'))"


_J4 = f"""a AS (SELECT DISTINCT publication_id, {_w('title')} AS w FROM publications WHERE title IS NOT NULL), b AS (SELECT oa_id, {_w('title')} AS w FROM open_access_results WHERE title IS NOT NULL),
    p AS (SELECT publication_id, oa_id, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS m, len(b.w) AS n FROM a JOIN b ON len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w)), j AS (SELECT *, shared::DOUBLE / (m + n - shared) AS jac FROM p)"""
SQL = {
    "j1_lookup_last": """WITH l AS (SELECT doc_id, document_kind, venue_name, row_number() OVER (PARTITION BY doc_id ORDER BY extracted_at DESC, confidence DESC) AS r FROM publications) SELECT x.doc_id, result_id, document_kind, venue_name FROM retrieval_results x LEFT JOIN l ON x.doc_id = l.doc_id AND l.r = 1""",
    "j2_semi": "SELECT publication_id, extracted_at FROM publications WHERE publication_id IN (SELECT publication_id FROM publication_authors WHERE orcid IS NOT NULL)",
    "j3_broken_refs": """SELECT DISTINCT 'never_retrieved' AS issue, doc_id FROM publications WHERE NOT EXISTS (SELECT 1 FROM retrieval_results r WHERE r.doc_id = publications.doc_id)
        UNION ALL SELECT DISTINCT 'unknown_document', doc_id FROM parsed_tables WHERE NOT EXISTS (SELECT 1 FROM publications p WHERE p.doc_id = parsed_tables.doc_id)""",
    "j4_similar_titles": f"WITH {_J4} SELECT publication_id, oa_id, shared, {_MICRO.format(x='jac')} AS jaccard FROM j WHERE jac >= 0.8",
    "j4_left_only": f"WITH {_J4} SELECT DISTINCT publication_id FROM publications WHERE title IS NOT NULL AND publication_id NOT IN (SELECT publication_id FROM j WHERE jac >= 0.8)",
    "j6_keywords_in_abstract": """WITH p AS (SELECT DISTINCT publication_id, lower(abstract) AS a, list_transform(keywords, lambda k: lower(k)) AS k FROM publications WHERE abstract IS NOT NULL AND keywords IS NOT NULL),
        e AS (SELECT publication_id, a, unnest(k) AS term, generate_subscripts(k, 1) AS place FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY publication_id, a ORDER BY place) AS n FROM e WHERE contains(a, term)) SELECT publication_id, term, place FROM r WHERE n <= 3""",
    "j9_dealt": "SELECT doc_id, (row_number() OVER (PARTITION BY section_kind ORDER BY doc_id) - 1) % 4 AS reader FROM documents",
    "j10_augmented": "SELECT c_nationkey, count(*) AS customers, (SELECT count(*) FROM customer) AS all_customers, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments FROM customer GROUP BY c_nationkey",
    "a1_counts": """WITH d AS (SELECT source, coalesce(lang, '-') AS lang FROM documents) SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, grouping_id(source, lang)::BIGINT AS level FROM d GROUP BY GROUPING SETS ((source), (lang), ())""",
    "a2_lengths": "SELECT source, sum(n_chars)::BIGINT AS chars, floor(median(n_chars))::BIGINT AS median_chars, max(n_chars) AS most FROM documents WHERE n_chars > 0 GROUP BY source",
    "a3_nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p95, n FROM r WHERE r = round_even((n - 1) * 0.95, 0)::BIGINT + 1",
    "a4_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {t}) AS filled, count(*) AS total, {_MICRO.format(x=f'count(*) FILTER (WHERE {t})::DOUBLE / nullif(count(*), 0)')} AS ratio FROM publications" for c, t in (("title", "title <> ''"), ("language", "language <> ''"), ("venue_name", "venue_name <> ''"), ("doi", "doi <> ''"), ("abstract", "abstract <> ''"), ("keywords", "len(keywords) > 0"))),
    "a5_duplicates": "SELECT result_id, min(result_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM retrieval_results",
    "a6_top_keywords": "WITH k AS (SELECT document_kind, unnest(keywords) AS keyword FROM publications), n AS (SELECT document_kind, keyword, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document_kind ORDER BY n DESC, keyword) AS rank FROM n) SELECT * FROM r WHERE rank <= 10",
    "a7_pivot": "SELECT lower(extension) AS extension, count(*) FILTER (WHERE extraction_status = 'ok') AS ok, count(*) FILTER (WHERE extraction_status = 'partial') AS partial, count(*) AS total FROM publications GROUP BY lower(extension)",
    "a8_merged": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1), e AS (SELECT publication_id, procedure_summary_id, unnest(equipment) AS e, generate_subscripts(equipment, 1) AS n FROM p),
        f AS (SELECT publication_id, e, row_number() OVER (PARTITION BY publication_id, e ORDER BY procedure_summary_id, n) AS k, procedure_summary_id, n FROM e), o AS (SELECT publication_id, e, row_number() OVER (PARTITION BY publication_id ORDER BY procedure_summary_id, n) AS r FROM f WHERE k = 1),
        q AS (SELECT publication_id, string_agg(e, '; ' ORDER BY r) AS equipment FROM o WHERE r <= 12 GROUP BY ALL), g AS (SELECT publication_id, max(confidence) AS confidence, arg_min(scale, procedure_summary_id) FILTER (WHERE scale <> '') AS scale, count(*) AS cards FROM p GROUP BY ALL)
        SELECT g.publication_id, coalesce(equipment, '') AS equipment, confidence, scale, cards FROM g LEFT JOIN q ON g.publication_id = q.publication_id""",
    "a9_last_wins": f"SELECT publication_id, count(*) AS rows, arg_max(confidence, extracted_at) AS last, {_MICRO.format(x='arg_max(confidence, extracted_at) - arg_min(confidence, extracted_at)')} AS moved FROM publications GROUP BY ALL HAVING count(*) > 1",
    "a10_mixed_units": """WITH m AS (SELECT unnest(process_parameters) AS m FROM procedure_summaries), u AS (SELECT m['name'] AS name, nullif(trim(m['unit']), '') AS unit FROM m), d AS (SELECT DISTINCT name, unit FROM u WHERE name IS NOT NULL AND unit IS NOT NULL)
        SELECT name, count(*) AS units, string_agg(unit, '|' ORDER BY unit) AS spellings FROM d GROUP BY ALL HAVING count(*) > 1""",
    "a12_share": f"WITH e AS (SELECT event_type, ts::DATE AS day, sum(floor(value * 100 + 0.5))::BIGINT AS cents FROM events WHERE value > 0 GROUP BY ALL) SELECT event_type, day, cents, {_MICRO.format(x='cents::DOUBLE / sum(cents) OVER (PARTITION BY day)')} AS share FROM e",
    "a13_spans": f"SELECT source_type, min(year) AS first_year, max(year) AS last_year, max(year) - min(year) AS span, {_MICRO.format(x='avg(year)')} AS mean_year FROM publications WHERE year IS NOT NULL GROUP BY ALL",
    "a14_evaluation": r"""WITH r AS (SELECT query_id, hit_rank, result_id, lower(coalesce(title, '')) AS t, lower(text) AS x FROM retrieval_results), b AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, result_id) AS k FROM r WHERE t <> ''),
        w AS (SELECT query_id, regexp_extract(t, '([\p{L}]{6,})', 1) AS word FROM b WHERE k = 1) SELECT r.query_id, coalesce(bool_or(contains(x, word)) FILTER (WHERE hit_rank = 1), false) AS top1, coalesce(bool_or(contains(x, word)) FILTER (WHERE hit_rank <= 3), false) AS top3 FROM r JOIN w ON r.query_id = w.query_id AND word <> '' GROUP BY ALL""",
    "w2_top3": "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT * FROM r WHERE r <= 3",
    "w3_latest": "WITH r AS (SELECT publication_id, confidence, extraction_status, row_number() OVER (PARTITION BY publication_id ORDER BY extracted_at DESC, confidence DESC) AS r FROM publications) SELECT publication_id, confidence, extraction_status FROM r WHERE r = 1",
    "w4_budget": "WITH r AS (SELECT query_id, result_id, sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY hit_rank, result_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM retrieval_results) SELECT * FROM r WHERE used - 2 <= 4000",
    "w5_route_cap": "WITH r AS (SELECT query_id, source_type, result_id, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, result_id) AS r FROM retrieval_results) SELECT * FROM r WHERE r <= 5",
    "w6_running_caps": "WITH t AS (SELECT doc_id, table_id, count(*) OVER w AS n, (sum(strlen(text)) OVER w)::BIGINT AS bytes FROM parsed_tables WINDOW w AS (PARTITION BY doc_id ORDER BY table_id ROWS UNBOUNDED PRECEDING)) SELECT *, CASE WHEN n <= 20 AND bytes <= 2500 THEN 'included' ELSE 'skipped' END AS status FROM t",
    "w7_last_event": "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS clicks FROM events WHERE event_type = 'click') SELECT user_id, event_id AS last_click, clicks FROM r WHERE r = 1",
    "o2_multi_key": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50",
    "o4_union_distinct": "WITH u AS (SELECT raw_name AS name, 1 AS src FROM publication_authors WHERE role = 'organization' UNION ALL SELECT venue_name, 2 FROM publications WHERE venue_name IS NOT NULL) SELECT name, min(src)::BIGINT AS first_seen FROM u GROUP BY ALL",
    "o5_overlap": f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1), w AS (SELECT procedure_summary_id, {_w('key_points')} AS a, {_w("array_to_string(list_transform(steps, lambda s: s.description), ' ')")} AS b FROM p)
        SELECT procedure_summary_id, len(list_intersect(a, b))::BIGINT AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS only_points, len(list_distinct(list_concat(a, b)))::BIGINT AS all_words FROM w""",
    "o6_positive_or_all": "WITH r AS (SELECT query_id, result_id, contains(text, 'pH')::INT AS s, max(contains(text, 'pH')::INT) OVER (PARTITION BY query_id) AS m FROM retrieval_results) SELECT query_id, result_id FROM r WHERE s > 0 OR m = 0",
    "o7_filter_or_fallback": "WITH r AS (SELECT source, year, oa_id, coalesce(open_access, false)::INT AS open, sum(coalesce(open_access, false)::INT) OVER (PARTITION BY source, year) AS n FROM open_access_results) SELECT source, coalesce(year, '') AS year, oa_id FROM r WHERE open = 1 OR n < 3",
    "o8_hash_sample": "SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id) LIMIT 100",
}
