"""Search, vectors and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import index as I  # noqa: E741, N812
from lodeline.operators import search as S
from lodeline.plans.text import TERMS, norm, toks
from lodeline.runtime import shared_dir, table

QUERY = "nickel flotation of lateritic ore with mine water"
_W = r"regexp_extract_all({n}, '[\p{{L}}\p{{N}}]+')"


def _words(x: str) -> str:
    return _W.format(n=norm(x))


def l1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(table(spark, sf_dir, "publications").where("title is not null").select("publication_id", "title").distinct(), "publication_id", "title")


def l1_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_frequency(S.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def l3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, 20).select(F.col("row_id").alias("doc_id"), T.micro(F.col("score")).alias("score"))


def l3_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, which is built first."""
    path = f"{shared_dir(spark)}/lodeline-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    I.build_lexical(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return I.bm25(spark, path, QUERY, 20).select(F.col("row_id").alias("doc_id"), T.micro(F.col("score")).alias("score"))


def l4_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", T.term_counts(T.tokens(F.col("text")), TERMS).alias("c"))
    tf = [F.col(f"c.t{i}") for i in range(len(TERMS))]
    score = sum(((f > 0).cast("int") for f in tf), F.lit(0)) * 10 + sum((F.least(f, F.lit(3)) for f in tf), F.lit(0)) / F.greatest(F.col("c.n"), F.lit(1))
    return n.select("doc_id", T.micro(score).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20).where("score > 0")


def v1_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.unit("embedding").alias("u"))
    return e.select("vec_id", F.size("u").cast("bigint").alias("dim"), T.micro(F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


def v2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query_id", "row_id", T.micro(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def v6_cache_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value written for each key of an append-only log."""
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return e.groupBy("key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def v9_vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("d"), n.alias("n"))
    return e.agg(
        F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), (F.max("vec_id") + 1 == F.count("*")).alias("contiguous"), F.min("d").cast("bigint").alias("least_dim"), F.max("d").cast("bigint").alias("most_dim"),
        F.count_if(F.isnan("n")).alias("not_finite"), F.count_if(~F.col("n").between(0.95, 1.05)).alias("bad_norms"),
    )


def f1_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector search fused by reciprocal ranks; vectors belong to the documents of their id."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    words = S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, 50)
    dense = S.nearest_one(e, "vec_id", "embedding", list(q["embedding"]) if q else [], 50)
    return S.rank_fusion([words, dense], 10).select("row_id", T.micro(F.col("score")).alias("score"), "streams")


def f2_weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each query by the sum of their components' best values, the ten best."""
    r = table(spark, sf_dir, "retrieval_results")
    parts = r.select("query_id", "candidate_id", F.explode("components").alias("component", "value")).where("value > 0")
    best = parts.groupBy("query_id", "candidate_id", "component").agg(F.max("value").alias("value"))
    total = best.groupBy("query_id", "candidate_id").agg(T.micro(F.sum("value")).alias("score"), F.count("*").alias("components"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")).cast("bigint")).where("rank <= 10")


def f5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of each query's hits, each once, in the order of first mention, at most eight."""
    r = table(spark, sf_dir, "retrieval_results").select("query_id", "hit_rank", "result_id", F.posexplode("reasons").alias("p", "reason"))
    first = r.groupBy("query_id", "reason").agg(F.min(F.struct("hit_rank", "result_id", "p")).alias("at"))
    return first.groupBy("query_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]), 1, 8), "; ").alias("reasons"))


def f6_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best open-access record per DOI, else per title: open ones first, then the latest."""
    o = table(spark, sf_dir, "open_access_results")
    key = F.coalesce(F.nullif(F.lower(F.regexp_extract("doi", r"(10\.[0-9]{4,9}/\S+)", 1)), F.lit("")), F.substring(F.regexp_replace(F.lower("title"), r"[^a-zа-яё0-9]", ""), 1, 120), F.col("oa_id"))
    w = Window.partitionBy("key").orderBy(F.desc("open_access"), F.desc("resolved_at"), "oa_id")
    return o.withColumn("key", key).withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "oa_id", "access_status")


def t1_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best twenty of publications' abstracts and procedures' key points together."""
    a = table(spark, sf_dir, "publications").select(F.lit("publication").alias("kind"), F.col("publication_id").alias("id"), F.col("abstract").alias("t")).where("t is not null").distinct()
    b = table(spark, sf_dir, "procedure_summaries").select(F.lit("procedure").alias("kind"), F.col("procedure_summary_id").alias("id"), F.col("key_points").alias("t")).where("t is not null").distinct()
    score = T.once(T.normalise(F.col("t")), lambda t: T.coverage(t, TERMS) * 10 + sum((T.occurrences(t, q) for q in TERMS), F.lit(0)))
    return a.unionByName(b).select("kind", "id", T.micro(score).alias("score")).orderBy(F.desc("score"), "kind", "id").limit(20).where("score > 0")


def t3_late_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read only for the best rows."""
    top = S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, 5).select(F.col("row_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(F.broadcast(top), "doc_id", "left_semi").select("doc_id", "source", F.length("text").cast("bigint").alias("chars"))  # five ids


def t4_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have tables, and those that have none, in one catalogue."""
    p, t = table(spark, sf_dir, "publications").select("doc_id").distinct(), table(spark, sf_dir, "parsed_tables")
    have = t.groupBy("doc_id").agg(F.count("*").alias("tables"))
    return have.unionByName(p.join(have, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("bigint").alias("tables")))


def t5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separator and number of columns of each table, from its first line that isn't blank; at most 24."""
    head = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1)
    h = table(spark, sf_dir, "parsed_tables").select("table_id", head.alias("h")).where("h is not null").withColumn("sep", S.separator(F.col("h")))
    n = F.when(F.col("sep") == " ", F.size(F.split(T.collapse(F.col("h")), " "))).otherwise(F.length("h") - F.length(F.replace("h", "sep", F.lit(""))) + 1)
    return h.select("table_id", F.when(F.col("sep") == "\t", "tab").otherwise(F.col("sep")).alias("separator"), F.least(n, F.lit(24)).cast("bigint").alias("columns"))


def t6_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by their header and document first, then rows of the best 32 only; three best rows of the best four tables."""
    words = ["flotation", "nickel", "флотация", "ni,"]
    t = table(spark, sf_dir, "parsed_tables")
    low = F.lower("text")
    first = t.select("table_id", sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("phase1")).where("phase1 > 0").orderBy(F.desc("phase1"), "table_id").limit(32)
    rows = S.table_rows(t.join(F.broadcast(first), "table_id", "left_semi"), "table_id", "text", 500)  # 32 ids
    scored = rows.withColumn("hits", sum((F.lower("row").contains(w).cast("int") for w in words), F.lit(0))).where("hits > 0")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("hits"), "row_no"))).where("r <= 3")
    agg = best.groupBy("table_id").agg(F.max("hits").cast("bigint").alias("best_row"), F.array_join(F.transform(F.array_sort(F.collect_list("row_no")), lambda x: x.cast("string")), ",").alias("rows"))
    return agg.join(first, "table_id").select("table_id", "best_row", "rows", (F.col("phase1") + F.col("best_row")).alias("score")).orderBy(F.desc("score"), "table_id").limit(4)


def t8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best table rows that hold at least two of the terms; earlier rows win ties."""
    words = ["flotation", "repeat", "grains", "флотация"]
    rows = S.table_rows(table(spark, sf_dir, "parsed_tables"), "table_id", "text")
    low = F.lower("row")
    hit = F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words)))
    x = rows.select("table_id", F.col("row_no").cast("bigint").alias("row_no"), F.size(hit).cast("bigint").alias("hits"), F.array_join(hit, " ").alias("terms")).where("hits >= 2")
    return x.orderBy(F.desc("hits"), "table_id", "row_no").limit(25)


QUERIES = {
    f.__name__: f
    for f in (l1_postings, l1_document_frequency, l3_bm25, l3_indexed, l4_scan, v1_norms, v2_nearest, v6_cache_last_write, v9_vector_validation, f1_hybrid, f2_weighted_fusion, f5_reasons, f6_best_per_key, t1_summaries, t3_late_text, t4_catalogue, t5_columns, t6_two_phase, t8_rows)
}

_MICRO = "CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = f"""tok AS (SELECT doc_id AS row_id, unnest({_words('text')}) AS term FROM documents), q AS (SELECT DISTINCT unnest({_words("'" + QUERY + "'")}) AS term),
    tf AS (SELECT row_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT row_id, count(*) AS dl FROM tok GROUP BY ALL), st AS (SELECT count(*) AS n, avg(CAST(dl AS DOUBLE)) AS avgdl FROM dl),
    df AS (SELECT tf.term, count(*) AS df FROM tf JOIN q ON tf.term = q.term GROUP BY ALL),
    bm AS (SELECT tf.row_id, sum((CASE WHEN ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) END) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.avgdl))) AS s
        FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.row_id = dl.row_id CROSS JOIN st GROUP BY ALL)"""
SQL = {
    "l1_postings": f"WITH t AS (SELECT DISTINCT publication_id, title FROM publications WHERE title IS NOT NULL), w AS (SELECT publication_id AS row_id, unnest({_words('title')}) AS term FROM t) SELECT row_id, term, count(*) AS tf FROM w GROUP BY ALL",
    "l1_document_frequency": f"WITH w AS (SELECT doc_id, unnest({_words('text')}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM t GROUP BY ALL",
    "l3_bm25": f"WITH {_BM25} SELECT row_id AS doc_id, {_MICRO.format(x='s')} AS score FROM bm ORDER BY s DESC, row_id LIMIT 20",
    "l4_scan": f"""WITH n AS (SELECT doc_id, {toks('text')} AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, list_transform([{_LIST}], lambda q: len(list_filter(t, lambda x: x = q))) AS tf FROM n WHERE len(t) > 0),
        s AS (SELECT doc_id, {_MICRO.format(x='len(list_filter(tf, lambda v: v > 0)) * 10 + list_sum(list_transform(tf, lambda v: least(v, 3))) / n')} AS score FROM f) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "v1_norms": f"SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1000000 ELSE 0 END::BIGINT AS norm FROM embeddings",
    "v2_nearest": f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM p) SELECT query_id, row_id, {_MICRO.format(x='s')} AS score, rank FROM r WHERE rank <= 10""",
    "v6_cache_last_write": "WITH r AS (SELECT user_id || ':' || event_type AS key, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT key, value, event_id FROM r WHERE r = 1",
    "v9_vector_validation": """WITH n AS (SELECT vec_id, len(embedding) AS d, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
        SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, max(vec_id) + 1 = count(*) AS contiguous, CAST(min(d) AS BIGINT) AS least_dim, CAST(max(d) AS BIGINT) AS most_dim, count(*) FILTER (WHERE isnan(n)) AS not_finite, count(*) FILTER (WHERE n NOT BETWEEN 0.95 AND 1.05) AS bad_norms FROM n""",
    "f1_hybrid": f"""WITH {_BM25}, lex AS (SELECT row_id, row_number() OVER (ORDER BY s DESC, row_id) AS r FROM bm), d AS (SELECT e.vec_id AS row_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0),
        den AS (SELECT row_id, row_number() OVER (ORDER BY s DESC, row_id) AS r FROM d), f AS (SELECT row_id, 1.0::DOUBLE / (60 + r) AS c FROM lex WHERE r <= 50 UNION ALL SELECT row_id, 1.0::DOUBLE / (60 + r) FROM den WHERE r <= 50),
        s AS (SELECT row_id, sum(c) AS s, count(*) AS streams FROM f GROUP BY ALL) SELECT row_id, {_MICRO.format(x='s')} AS score, streams FROM s ORDER BY s DESC, row_id LIMIT 10""",
    "f2_weighted_fusion": f"""WITH p AS (SELECT query_id, candidate_id, unnest(map_entries(components)) AS e FROM retrieval_results), b AS (SELECT query_id, candidate_id, e.key AS component, max(e.value) AS value FROM p WHERE e.value > 0 GROUP BY ALL),
        t AS (SELECT query_id, candidate_id, {_MICRO.format(x='sum(value)')} AS score, count(*) AS components FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM t) SELECT * FROM r WHERE rank <= 10""",
    "f5_reasons": """WITH e AS (SELECT query_id, hit_rank, result_id, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS p FROM retrieval_results), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, reason ORDER BY hit_rank, result_id, p) AS k FROM e),
        o AS (SELECT query_id, reason, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, result_id, p) AS n FROM r WHERE k = 1) SELECT query_id, string_agg(reason, '; ' ORDER BY n) AS reasons FROM o WHERE n <= 8 GROUP BY ALL""",
    "f6_best_per_key": r"""WITH k AS (SELECT *, coalesce(nullif(lower(regexp_extract(doi, '(10\.[0-9]{4,9}/\S+)', 1)), ''), substr(regexp_replace(lower(title), '[^a-zа-яё0-9]', '', 'g'), 1, 120), oa_id) AS key FROM open_access_results),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY open_access DESC NULLS LAST, resolved_at DESC NULLS LAST, oa_id) AS r FROM k) SELECT key, oa_id, access_status FROM r WHERE r = 1""",
    "t1_summaries": f"""WITH x AS (SELECT DISTINCT 'publication' AS kind, publication_id AS id, abstract AS t FROM publications WHERE abstract IS NOT NULL UNION ALL SELECT DISTINCT 'procedure', procedure_summary_id, key_points FROM procedure_summaries WHERE key_points IS NOT NULL),
        n AS (SELECT kind, id, {norm('t')} AS t FROM x), s AS (SELECT kind, id, {_MICRO.format(x=f"len(list_filter([{_LIST}], lambda q: contains(t, q))) / {float(len(TERMS))} * 10 + list_sum(list_transform([{_LIST}], lambda q: (length(t) - length(replace(t, q, ''))) // length(q)))")} AS score FROM n)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, kind, id LIMIT 20""",
    "t3_late_text": f"WITH {_BM25}, top AS (SELECT row_id FROM bm ORDER BY s DESC, row_id LIMIT 5) SELECT doc_id, source, length(text) AS chars FROM documents WHERE doc_id IN (SELECT row_id FROM top)",
    "t4_catalogue": "SELECT doc_id, count(*) AS tables FROM parsed_tables GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, 0::BIGINT FROM publications WHERE doc_id NOT IN (SELECT doc_id FROM parsed_tables WHERE doc_id IS NOT NULL)",
    "t5_columns": r"""WITH l AS (SELECT table_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS h FROM parsed_tables), s AS (SELECT *, CASE WHEN contains(h, chr(9)) THEN chr(9) WHEN contains(h, '|') THEN '|' WHEN contains(h, ';') THEN ';' WHEN contains(h, ',') THEN ',' ELSE ' ' END AS sep FROM l WHERE h IS NOT NULL)
        SELECT table_id, CASE WHEN sep = chr(9) THEN 'tab' ELSE sep END AS separator, least(CASE WHEN sep = ' ' THEN len(string_split(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '^ | $', '', 'g'), ' ')) ELSE length(h) - length(replace(h, sep, '')) + 1 END, 24)::BIGINT AS columns FROM s""",
    "t6_two_phase": """WITH f AS (SELECT table_id, text, len(list_filter(['flotation', 'nickel', 'флотация', 'ni,'], lambda w: contains(lower(text), w))) AS phase1 FROM parsed_tables), t AS (SELECT * FROM f WHERE phase1 > 0 ORDER BY phase1 DESC, table_id LIMIT 32),
        r AS (SELECT table_id, phase1, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM t), h AS (SELECT *, len(list_filter(['flotation', 'nickel', 'флотация', 'ni,'], lambda w: contains(lower(row), w))) AS hits FROM r WHERE trim(row) <> '' AND row_no <= 500),
        b AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY hits DESC, row_no) AS k FROM h WHERE hits > 0), a AS (SELECT table_id, phase1, max(hits) AS best_row, string_agg(row_no::VARCHAR, ',' ORDER BY row_no) AS rows FROM b WHERE k <= 3 GROUP BY ALL)
        SELECT table_id, best_row::BIGINT AS best_row, rows, (phase1 + best_row)::BIGINT AS score FROM a ORDER BY score DESC, table_id LIMIT 4""",
    "t8_rows": """WITH r AS (SELECT table_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM parsed_tables), h AS (SELECT table_id, row_no::BIGINT AS row_no, list_filter(['flotation', 'repeat', 'grains', 'флотация'], lambda w: contains(lower(row), w)) AS t FROM r WHERE trim(row) <> '')
        SELECT table_id, row_no, len(t)::BIGINT AS hits, array_to_string(t, ' ') AS terms FROM h WHERE len(t) >= 2 ORDER BY hits DESC, table_id, row_no LIMIT 25""",
}
SQL["l3_indexed"] = SQL["l3_bm25"]
