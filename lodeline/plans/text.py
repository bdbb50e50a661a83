"""Text preparation and scalar scoring over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import chunking
from lodeline.runtime import table

TERMS = ["nickel", "flotation", "water", "leaching", "никель", "флотация"]
QUOTED = '[«“"]([^«»“”"\\n]{3,60})[»”"]'
DOMAIN = ("nickel", "copper", "cobalt", "flotation", "leach", "slag", "matte", "никел", "медь", "медн", "флотац", "шлак", "выщелач")
CONCEPTS = {"nickel": ["ni", "nickel", "никел"], "copper": ["cu", "copper", "мед"], "water": ["mine water", "шахтная вода", "water"], "leaching": ["leach", "выщелачив"]}

_NORM = r"replace(replace(lower(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')), 'ß', 'ss'), 'ё', 'е')"
_TOKENS = r"list_filter(list_transform(regexp_extract_all({n}, '[\p{{L}}\p{{N}}_.+#%-]+'), lambda t: regexp_replace(t, '^[.+#%_-]+|[.+#%_-]+$', '', 'g')), lambda t: length(t) >= 2)"


def norm(x: str) -> str:
    return _NORM.format(x=x)


def toks(x: str) -> str:
    return _TOKENS.format(n=norm(x))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def prep1_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = chunking.fixed_chunks(documents(spark, sf_dir), "doc_id", "text", 1000, 800)
    return x.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_id", F.length("chunk").cast("bigint").alias("chars"))


def prep1_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(documents(spark, sf_dir), "doc_id", "text").drop("chunk")


def prep2_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.compact(F.col("text"), 160).alias("preview"))


def prep3_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval_results").select("result_id", T.snippet(F.col("text"), 240).alias("snippet"))


def prep4_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.prepared(F.col("text"), 300, 60).alias("prepared"))


def prep5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "publications").select("publication_id", "extracted_at", T.normalise(F.col("title")).alias("title"))


def prep6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("terms"), F.array_join(F.slice(F.array_distinct("t"), 1, 16), " ").alias("first_terms"))


def prep8_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve keywords of each document: quoted phrases in their order, then words by domain, digits and frequency, length and the word itself."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    quoted = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)), T.normalise), lambda x: F.length(x) >= 4))
    phrases = d.select("doc_id", F.posexplode(quoted).alias("p", "word")).select("doc_id", "word", F.lit(1).cast("bigint").alias("n"), F.col("p").cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("score"))
    w = d.select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).where(F.length("word") >= 4).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    domain = sum((F.col("word").startswith(t).cast("int") for t in DOMAIN), F.lit(0)) > 0
    score = F.when(domain, 3).otherwise(0) + F.when(F.col("word").rlike("[0-9]"), 2).otherwise(0) + F.col("n")
    single = w.select("doc_id", "word", "n", F.lit(1 << 30).cast("bigint").alias("p"), score.cast("bigint").alias("score"))
    ranked = phrases.unionByName(single).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("p", F.desc("score"), F.length("word").desc(), F.desc("word"))))
    return ranked.where("rank <= 12").select("doc_id", "word", "n", F.col("rank").cast("bigint").alias("rank"))


def prep9_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a procedure card as lines ``field: a; b``; empty fields give no line."""
    p = table(spark, sf_dir, "procedure_summaries")
    line = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, "; ")))
    return p.select("procedure_summary_id", F.concat_ws("\n", F.when(F.col("material_name") != "", F.concat(F.lit("material: "), "material_name")), line("materials"), line("processes"), line("equipment")).alias("flat")).distinct()


def prep10_split_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of long or separated values, of 2 to 160 characters."""
    p = table(spark, sf_dir, "procedure_summaries")
    parts = F.filter(F.transform(F.split("key_points", r"[;\n.]"), T.collapse), lambda x: F.length(x).between(2, 160))
    return p.select("procedure_summary_id", F.explode(parts).alias("part")).distinct()


def prep12_script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.script_language(F.col("text"), None).alias("language"))


def prep13_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, numbers with units, DOIs without trailing marks and e-mail addresses, each once a text."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    o = table(spark, sf_dir, "open_access_results").select(F.col("oa_id").alias("doc_id"), F.concat_ws(" ", "doi", "landing_page_url", "best_pdf_url").alias("text"))
    a = table(spark, sf_dir, "publication_authors").select(F.col("author_id").alias("doc_id"), F.concat_ws(" ", "raw_name", "email").alias("text"))
    return _extracted(d.unionByName(o).unionByName(a)).distinct()


def _extracted(d: DataFrame) -> DataFrame:
    lower = F.lower("text")
    found = {"year": T.matches(F.col("text"), T.YEAR, 1), "number": T.matches(F.col("text"), T.NUMBER_UNIT), "doi": F.transform(F.regexp_extract_all(lower, F.lit(T.DOI), F.lit(0)), lambda x: F.regexp_replace(x, "[.,;)]+$", "")), "email": T.matches(lower, T.EMAIL)}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in found.items()))
    return d.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.v").alias("value"))


def prep15_display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    t = F.when(F.col("title").isNull() | (F.trim("title") == "") | T.hash_like(F.col("title")), F.lit(None)).otherwise(F.col("title"))
    return d.select("doc_id", F.coalesce(t, T.compact(F.col("text"), 60), F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("display_title"))


def x1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.once(T.normalise(F.col("text")), lambda t: T.coverage(t, TERMS))
    return documents(spark, sf_dir).select("doc_id", T.micro(score).alias("coverage")).where("coverage > 0")


def x2_coverage_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.once(T.normalise(F.col("text")), lambda t: F.struct(T.coverage(t, TERMS).alias("c"), sum((T.occurrences(t, x) for x in TERMS), F.lit(0)).alias("total")))
    n = documents(spark, sf_dir).select("doc_id", hits.alias("h"), F.size(T.tokens(F.col("text"))).alias("n")).where("h.total > 0 and n > 0")
    return n.select("doc_id", T.micro(F.col("h.c") * 10 + F.least(F.col("h.total") / F.col("n"), F.lit(1.0))).alias("score"))


def x3_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = documents(spark, sf_dir).select("doc_id", T.term_counts(T.tokens(F.col("text")), TERMS).alias("c"))
    tf = [F.col(f"c.t{i}") for i in range(len(TERMS))]
    hit, part = sum(((f > 0).cast("int") for f in tf), F.lit(0)), sum((F.least(f, F.lit(3)) for f in tf), F.lit(0))
    scored = n.select("doc_id", F.struct(hit.alias("hit"), T.micro(hit / F.lit(float(len(TERMS))) * 10 + part / F.greatest(F.col("c.n"), F.lit(1))).alias("score")).alias("s"))
    return scored.where("s.hit > 0").select("doc_id", "s.score")


def x4_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.struct(T.normalise(F.col("text")).alias("t"), T.tokens(F.col("text")).alias("k"))
    tags = T.once(both, lambda x: F.array(*(F.when(sum((T.alias_match(x["t"], x["k"], a).cast("int") for a in names), F.lit(0)) > 0, F.lit(c)) for c, names in CONCEPTS.items())))
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array_compact(tags)).alias("concept"))


def x5_short_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = documents(spark, sf_dir).select("doc_id", T.normalise(F.col("text")).alias("t"))
    return n.where(T.has_term(F.col("t"), "kt") | T.has_term(F.col("t"), "so2")).select("doc_id", T.has_term(F.col("t"), "kt").alias("kt"), T.has_term(F.col("t"), "so2").alias("so2"))


def x6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "publications").where("title is not null").select("publication_id", T.words(F.col("title")).alias("w"))
    return w.select("publication_id", F.explode(F.concat(T.ngrams(F.col("w"), 3), T.ngrams(F.col("w"), 2))).alias("gram")).distinct()


def x8_freshness(spark: SparkSession, sf_dir: str, as_of_year: int = 2026) -> DataFrame:
    """1 up to three years of age, 0.1 from twenty on, falling between; null years count as oldest."""
    age = F.lit(as_of_year) - F.col("published_year")
    f = F.when(age.isNull(), 0.1).when(age <= 3, 1.0).when(age >= 20, 0.1).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - (age - 3) / F.lit(20.0)))
    return documents(spark, sf_dir).select("doc_id", T.micro(f).alias("freshness"))


def x16_quality_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of each publication's text by how it was parsed and how much came out; a PDF with little text is a kind of its own."""
    p = table(spark, sf_dir, "publications")
    n = F.length(T.collapse(F.coalesce("abstract", F.lit(""))))
    pdf = F.lower("extension") == ".pdf"
    label = F.when(F.lower("extension").isin(".zip", ".exe", ".bin"), "unsupported").when(F.col("extraction_status") == "failed", "failed").when(n == 0, "empty").when(pdf & (n < 200), "low_text_pdf").when(n < 500, "low_text").otherwise("ok")
    return p.select("publication_id", "extracted_at", label.alias("label"))


def x17_bad_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a title says little, and its confidence capped for that."""
    t = F.coalesce(T.collapse(F.col("title")), F.lit(""))
    why = (
        F.when(t == "", "missing").when(T.hash_like(F.col("title")), "hash").when(F.length(t) < 12, "short").when(~t.contains(" "), "single_word")
        .when(t.rlike(r"^[\p{L}-]+: [0-9]{4}$"), "label").otherwise("ok")
    )
    return documents(spark, sf_dir).select("doc_id", why.alias("reason"), F.when(why == "ok", 900000).otherwise(300000).cast("bigint").alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        prep1_fixed_chunks, prep1_window_chunks, prep2_compact, prep3_snippet, prep4_prepared, prep5_normalised, prep6_tokens, prep8_keywords, prep9_flattened, prep10_split_entities, prep12_script_language, prep13_extracted,
        prep15_display_title, x1_coverage, x2_coverage_density, x3_term_frequency, x4_concepts, x5_short_terms, x6_ngrams, x8_freshness, x16_quality_label, x17_bad_title,
    )
}

_COLLAPSE = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_C = _COLLAPSE.format(x="text")
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_MICRO = "CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"


def _compact(x: str, n: int) -> str:
    c = _COLLAPSE.format(x=x)
    return rf"CASE WHEN length({c}) > {n} THEN regexp_replace(substr({c}, 1, {n - 3}), '\s+$', '') || '...' ELSE {c} END"


def _alias_sql() -> str:
    rows = []
    for c, names in CONCEPTS.items():
        tests = []
        for a in names:
            if len(a) <= 3 and a.isascii():
                tests.append(f"list_contains(k, '{a}')")
            elif " " in a or "-" in a:
                tests.append(f"contains(t, '{a}')")
            else:
                tests.append(f"len(list_filter(k, lambda z: starts_with(z, '{a}'))) > 0")
        rows.append(f"SELECT doc_id, '{c}' AS concept FROM n WHERE {' OR '.join(tests)}")
    return f"WITH n AS (SELECT doc_id, {norm('text')} AS t, {toks('text')} AS k FROM documents) " + " UNION ALL ".join(rows)


_STRIP = r"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f]+', ''), '[\s\p{{Z}}\x1c-\x1f]+$', '')"
_MARK = r"greatest(CASE WHEN instr(reverse(substr(t, {s} + 1, 3500)), chr(10)) > 0 THEN 3501 - instr(reverse(substr(t, {s} + 1, 3500)), chr(10)) ELSE 0 END, CASE WHEN instr(reverse(substr(t, {s} + 1, 3500)), ' .') > 0 THEN 3500 - instr(reverse(substr(t, {s} + 1, 3500)), ' .') ELSE 0 END)"
_STOP = "CASE WHEN {s} + 3500 >= length(t) THEN length(t) WHEN " + _MARK + " - 1 > 300 THEN {s} + " + _MARK + " ELSE {s} + 3500 END"
_COV = f"len(list_filter([{_LIST}], lambda q: contains(t, q))) / {float(len(TERMS))}"
SQL = {
    "prep1_fixed_chunks": """WITH c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) + 1 END)) AS chunk_no FROM documents WHERE length(text) > 0),
        s AS (SELECT doc_id, chunk_no, substr(text, chunk_no * 800 + 1, 1000) AS chunk FROM c)
        SELECT doc_id, chunk_no, substr(sha1(doc_id || ':' || chunk_no || ':' || substr(chunk, 1, 80)), 1, 16) AS chunk_id, length(chunk) AS chars FROM s""",
    "prep1_window_chunks": rf"""WITH RECURSIVE c AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[\n\r\x0b\x0c\x1c-\x1e]+'), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10)) AS t FROM documents),
        w AS (SELECT doc_id, t, 0 AS s, {_STOP.format(s='0')} AS e, 1 AS k FROM c WHERE length(t) >= 300
        UNION ALL SELECT doc_id, t, s2, {_STOP.format(s='s2')}, k + 1 FROM (SELECT doc_id, t, greatest(e - 400, s + 1) AS s2, k FROM w WHERE e < length(t))),
        p AS (SELECT doc_id, k, {_STRIP.format(x='substr(t, s + 1, e - s)')} AS chunk FROM w), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS chunk_index, chunk FROM p WHERE length(chunk) >= 300)
        SELECT doc_id, chunk_index::INT AS chunk_index, substr(sha1(doc_id || ':' || chunk_index || ':' || substr(chunk, 1, 80)), 1, 16) AS chunk_id, length(chunk) AS chars FROM r""",
    "prep2_compact": f"SELECT doc_id, {_compact('text', 160)} AS preview FROM documents",
    "prep3_snippet": r"SELECT result_id, CASE WHEN length(text) > 240 THEN regexp_replace(substr(text, 1, 237), '\s+$', '') || '...' ELSE text END AS snippet FROM retrieval_results",
    "prep4_prepared": f"""WITH w AS (SELECT doc_id, array_to_string(string_split({_C}, ' ')[1:60], ' ') AS w FROM documents), h AS (SELECT doc_id, w, substr(w, 1, 300) AS h FROM w),
        a AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' .') > 0 THEN length(h) - instr(reverse(h), ' .') ELSE 0 END, CASE WHEN instr(reverse(h), ' ;') > 0 THEN length(h) - instr(reverse(h), ' ;') ELSE 0 END, CASE WHEN instr(reverse(h), ' ') > 0 THEN length(h) - instr(reverse(h), ' ') + 1 ELSE 0 END) AS cut_at FROM h)
        SELECT doc_id, CASE WHEN length(w) <= 300 THEN w WHEN cut_at > 150 THEN substr(h, 1, cut_at) ELSE h END AS prepared FROM a""",
    "prep5_normalised": f"SELECT publication_id, extracted_at, {norm('title')} AS title FROM publications",
    "prep6_tokens": f"""WITH t AS (SELECT doc_id, {toks('text')} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM t),
        d AS (SELECT doc_id, w, min(p) AS p, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM d)
        SELECT t.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, count(w) AS terms, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE k <= 16), '') AS first_terms FROM t LEFT JOIN r ON t.doc_id = r.doc_id GROUP BY t.doc_id""",
    "prep8_keywords": rf"""WITH q AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{QUOTED}', 1), lambda x: {norm('x')}), lambda x: length(x) >= 4) AS q FROM documents),
        u AS (SELECT doc_id, unnest(q) AS word, generate_subscripts(q, 1) AS p FROM q), f AS (SELECT doc_id, word, 1::BIGINT AS n, min(p) AS p, 0 AS score FROM u GROUP BY ALL),
        w AS (SELECT doc_id, unnest(regexp_extract_all({norm('text')}, '[\p{{L}}\p{{N}}]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY ALL),
        a AS (SELECT doc_id, word, n, p, score FROM f UNION ALL SELECT doc_id, word, n, 1073741824, (CASE WHEN {' OR '.join(f"starts_with(word, '{t}')" for t in DOMAIN)} THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(word, '[0-9]') THEN 2 ELSE 0 END) + n FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, score DESC, length(word) DESC, word DESC) AS rank FROM a) SELECT doc_id, word, n, rank FROM r WHERE rank <= 12""",
    "prep9_flattened": """SELECT DISTINCT procedure_summary_id, concat_ws(chr(10), CASE WHEN material_name <> '' THEN 'material: ' || material_name END, CASE WHEN len(materials) > 0 THEN 'materials: ' || array_to_string(materials, '; ') END,
        CASE WHEN len(processes) > 0 THEN 'processes: ' || array_to_string(processes, '; ') END, CASE WHEN len(equipment) > 0 THEN 'equipment: ' || array_to_string(equipment, '; ') END) AS flat FROM procedure_summaries""",
    "prep10_split_entities": r"""WITH p AS (SELECT procedure_summary_id, unnest(regexp_split_to_array(key_points, '[;\n.]')) AS x FROM procedure_summaries), c AS (SELECT procedure_summary_id, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g') AS part FROM p)
        SELECT DISTINCT procedure_summary_id, part FROM c WHERE length(part) BETWEEN 2 AND 160""",
    "prep12_script_language": """WITH c AS (SELECT doc_id, text, length(regexp_replace(lower(text), '[^а-яё]', '', 'g')) AS ru, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS en FROM documents)
        SELECT doc_id, CASE WHEN text IS NULL OR greatest(ru, en) = 0 THEN 'unknown' WHEN least(ru, en) / greatest(ru, en) > 0.2 THEN 'mixed' WHEN ru > en THEN 'ru' ELSE 'en' END AS language FROM c""",
    "prep13_extracted": r"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents UNION ALL SELECT oa_id, concat_ws(' ', doi, landing_page_url, best_pdf_url) FROM open_access_results UNION ALL SELECT author_id, concat_ws(' ', raw_name, email) FROM publication_authors)
        SELECT DISTINCT doc_id, 'year' AS kind, unnest(regexp_extract_all(text, '(19[5-9][0-9]|20[0-2][0-9]|203[0-5])', 1)) AS value FROM d
        UNION SELECT doc_id, 'number' AS kind, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)? ?(?:%|°C|mg/L|mm|m3/h|kt|Mt|h|s)')) AS value FROM d
        UNION SELECT doc_id, 'doi' AS kind, unnest(list_transform(regexp_extract_all(lower(text), '10\.[0-9]{4,9}/[^\s"<>]+'), lambda x: regexp_replace(x, '[.,;)]+$', ''))) AS value FROM d
        UNION SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS value FROM d""",
    "prep15_display_title": f"""SELECT doc_id, coalesce(CASE WHEN title IS NULL OR trim(title) = '' OR regexp_matches(lower(trim(title)), '^([0-9a-f]{{12,}}|[0-9]+|no [0-9]+)$') THEN NULL ELSE title END, {_compact('text', 60)}, 'document ' || doc_id) AS display_title FROM documents""",
    "x1_coverage": f"WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents), s AS (SELECT doc_id, {_MICRO.format(x=_COV)} AS coverage FROM n) SELECT * FROM s WHERE coverage > 0",
    "x2_coverage_density": f"""WITH n AS (SELECT doc_id, {norm('text')} AS t, len({toks('text')}) AS n FROM documents), o AS (SELECT *, list_sum(list_transform([{_LIST}], lambda q: (length(t) - length(replace(t, q, ''))) // length(q))) AS total FROM n WHERE n > 0),
        s AS (SELECT doc_id, {_MICRO.format(x=f'{_COV} * 10 + least(total / n, 1.0::DOUBLE)')} AS score FROM o) SELECT * FROM s WHERE score > 0""",
    "x3_term_frequency": f"""WITH n AS (SELECT doc_id, {toks('text')} AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, list_transform([{_LIST}], lambda q: len(list_filter(t, lambda x: x = q))) AS tf FROM n WHERE len(t) > 0),
        s AS (SELECT doc_id, {_MICRO.format(x=f'len(list_filter(tf, lambda v: v > 0)) / {float(len(TERMS))} * 10 + list_sum(list_transform(tf, lambda v: least(v, 3))) / n')} AS score FROM f) SELECT * FROM s WHERE score > 0""",
    "x4_concepts": _alias_sql(),
    "x5_short_terms": rf"""WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents), f AS (SELECT doc_id, regexp_matches(t, '(^|[^\p{{L}}\p{{N}}])kt([^\p{{L}}\p{{N}}]|$)') AS kt, contains(t, 'so2') AS so2 FROM n) SELECT * FROM f WHERE kt OR so2""",
    "x6_ngrams": rf"""WITH w AS (SELECT publication_id, regexp_extract_all({norm('title')}, '[\p{{L}}\p{{N}}]+') AS w FROM publications WHERE title IS NOT NULL),
        g AS (SELECT publication_id, unnest(list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')), list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')))) AS gram FROM w) SELECT DISTINCT * FROM g""",
    "x8_freshness": f"""WITH a AS (SELECT doc_id, 2026 - published_year AS age FROM documents) SELECT doc_id, {_MICRO.format(x='CASE WHEN age IS NULL THEN 0.1 WHEN age <= 3 THEN 1.0 WHEN age >= 20 THEN 0.1 ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - (age - 3) / 20.0::DOUBLE) END')} AS freshness FROM a""",
    "x16_quality_label": f"WITH p AS (SELECT publication_id, extracted_at, lower(extension) AS x, extraction_status AS e, length({_COLLAPSE.format(x="coalesce(abstract, '')")}) AS n FROM publications) SELECT publication_id, extracted_at, CASE WHEN x IN ('.zip', '.exe', '.bin') THEN 'unsupported' WHEN e = 'failed' THEN 'failed' WHEN n = 0 THEN 'empty' WHEN x = '.pdf' AND n < 200 THEN 'low_text_pdf' WHEN n < 500 THEN 'low_text' ELSE 'ok' END AS label FROM p",
    "x17_bad_title": rf"""WITH t AS (SELECT doc_id, title, coalesce({_COLLAPSE.format(x='title')}, '') AS t FROM documents),
        r AS (SELECT doc_id, CASE WHEN t = '' THEN 'missing' WHEN regexp_matches(lower(trim(title)), '^([0-9a-f]{{12,}}|[0-9]+|no [0-9]+)$') THEN 'hash' WHEN length(t) < 12 THEN 'short' WHEN NOT contains(t, ' ') THEN 'single_word' WHEN regexp_matches(t, '^[\p{{L}}-]+: [0-9]{{4}}$') THEN 'label' ELSE 'ok' END AS reason FROM t)
        SELECT doc_id, reason, CAST(CASE WHEN reason = 'ok' THEN 900000 ELSE 300000 END AS BIGINT) AS confidence FROM r""",
}
