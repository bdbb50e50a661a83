"""Signals, labels, query intents and record assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import embedding
from lodeline.operators import graph as G
from lodeline.plans.graph import _M, _mentions
from lodeline.plans.text import CONCEPTS, norm
from lodeline.runtime import table

# Intents in the order in which they are tried, with the words that show them.
INTENTS = (
    ("compare", ("comparison", "compared", "versus", "сравнен", "vergleich")),
    ("table", ("table of", "таблиц", "tabelle")),
    ("influence", ("influence of", "effect of", "влияние")),
    ("expert", ("who ", "expert", "кто ", "автор")),
    ("control", ("control", "регулир", "optimi")),
    ("gap", ("open question", "missing", "пробел", "не изучен")),
    ("site_study", ("site of", "at the", "месторожден", "участк", "site de", "planta de")),
    ("overview", ("perspectives", "perspectivas", "überblick", "показники", "review", "обзор")),
)
FIELDS = ("ore", "slag", "water", "руда", "шлак", "вода")
PHRASES = ("heap leaching", "mine water", "nickel matte", "шахтная вода", "никелевый штейн")


def x7_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase, concept and field signals of publication titles, each from 0 to 1, and their weighted sum."""
    p = table(spark, sf_dir, "publications").select("publication_id", "title").where("title is not null").distinct()
    s = T.once(F.struct(T.normalise(F.col("title")).alias("t"), T.tokens(F.col("title")).alias("k")), lambda x: F.struct(
        sum((x["t"].contains(q).cast("int") for q in PHRASES), F.lit(0)).alias("phrases"),
        sum(((sum((T.alias_match(x["t"], x["k"], a).cast("int") for a in names), F.lit(0)) > 0).cast("int") for names in CONCEPTS.values()), F.lit(0)).alias("concepts"),
        sum((F.array_contains(x["k"], q).cast("int") for q in FIELDS), F.lit(0)).alias("fields"),
    ))
    v = p.select("publication_id", s.alias("s"))
    score = F.least(F.lit(1.0), F.col("s.phrases") / 4.0) * 0.08 + F.col("s.concepts") / float(len(CONCEPTS)) * 0.12 + F.least(F.lit(1.0), F.col("s.fields") / float(len(FIELDS))) * 0.04
    return v.select("publication_id", F.col("s.phrases").cast("bigint").alias("phrases"), F.col("s.concepts").cast("bigint").alias("concepts"), F.col("s.fields").cast("bigint").alias("fields"), T.micro(score).alias("score")).where("score > 0")


def x9_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's confidence raised by its keywords, within 0 and 1; a missing one counts as a half."""
    p = table(spark, sf_dir, "publications")
    c = F.coalesce("confidence", F.lit(0.5)) + F.least(F.lit(0.4), F.lit(0.1) * F.coalesce(F.size("keywords"), F.lit(0)))
    return p.select("publication_id", "extracted_at", T.micro(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).alias("confidence"))


def x12_rule_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for groups of words that occur, and against one that occurs alone."""
    d = table(spark, sf_dir, "documents")
    s = T.once(F.lower("text"), lambda t: F.when(t.contains("nickel") | t.contains("никел"), 2.0).otherwise(0.0) + F.when((t.contains("nickel") & t.contains("ore")) | (t.contains("никел") & t.contains("руд")), 2.0).otherwise(0.0) - F.when((t.contains("copper") | t.contains("меди")) & ~(t.contains("nickel") | t.contains("никел")), 2.5).otherwise(0.0))
    return d.select("doc_id", T.micro(s).alias("boost")).where("boost <> 0")


def x13_literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of outside records by title words, identifiers, year and openness, the best thirty."""
    o = table(spark, sf_dir, "open_access_results")
    year = F.coalesce(F.expr("try_cast(regexp_extract(year, '((19|20)[0-9]{2})', 1) as int)"), F.lit(2000))
    hits = T.once(F.coalesce(T.normalise(F.col("title")), F.lit("")), lambda t: sum((t.contains(q).cast("int") for q in FIELDS), F.lit(0)))
    s = hits * 5 + F.when(F.coalesce(F.col("doi"), F.lit("")) != "", 1).otherwise(0) + F.greatest(F.lit(0), year - 2000) / 100.0 + F.when(F.coalesce("open_access", F.lit(False)), 0.5).otherwise(0.0)
    return o.select("oa_id", T.micro(s).alias("score")).orderBy(F.desc("score"), "oa_id").limit(30)


def x14_venue_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a publication's venue by how much the venue publishes; the table of venues is joined, not broadcast by hint."""
    p = table(spark, sf_dir, "publications").dropDuplicates(["publication_id"])
    v = p.where("venue_name is not null").groupBy(T.normalise(F.col("venue_name")).alias("v")).agg(F.count("*").alias("n"))
    x = p.select("publication_id", T.normalise(F.col("venue_name")).alias("v")).join(v, "v", "left")
    return x.select("publication_id", F.when(F.col("n").isNull(), "none").when(F.col("n") >= 50, "A").when(F.col("n") >= 20, "B").otherwise("C").alias("venue_class"))


def x15_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each hit as a percentage within bounds, and its label."""
    r = table(spark, sf_dir, "retrieval_results")
    pct = F.least(F.lit(98), F.greatest(F.lit(5), F.floor(F.col("score") * 100 + 0.5))).cast("bigint")
    return r.select("result_id", pct.alias("percent")).withColumn("label", F.when(F.col("percent") >= 75, "high").when(F.col("percent") >= 45, "medium").otherwise("low"))


def x18_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a document by extension and source."""
    e = F.lower("extension")
    k = F.when(e.isin(".xls", ".xlsx", ".csv"), "table").when(e.isin(".ppt", ".pptx"), "slides").when(F.lower("source_type").contains("конференц"), "conference").when(e == ".pdf", "article").otherwise("text")
    return table(spark, sf_dir, "publications").select("publication_id", k.alias("kind")).distinct()


def q1_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of each title taken as a query: the first intent that one of its words shows (search where none does), its concepts, its years, and the form of the answer."""
    p = table(spark, sf_dir, "publications").select("publication_id", F.lower("title").alias("t"), T.normalise(F.col("title")).alias("n"), T.tokens(F.col("title")).alias("k")).where("t is not null").distinct()
    c = None
    for name, words in INTENTS:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.col("t").contains(w)
        c = F.when(cond, name) if c is None else c.when(cond, name)
    concepts = F.array_compact(F.array(*(F.when(sum((T.alias_match(F.col("n"), F.col("k"), a).cast("int") for a in names), F.lit(0)) > 0, F.lit(x)) for x, names in CONCEPTS.items())))
    x = p.select("publication_id", c.otherwise("search").alias("intent"), F.array_join(concepts, ",").alias("concepts"), F.array_join(T.matches(F.col("t"), T.YEAR, 1), ",").alias("years"))
    return x.withColumn("answer", F.when(F.col("intent").isin("compare", "table"), "table").when(F.col("intent") == "expert", "list").otherwise("text"))


def q2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query variants of a publication: title, keywords, title with the first keyword; each once, at most eight."""
    p = table(spark, sf_dir, "publications").dropDuplicates(["publication_id"]).where("title is not null")
    k = F.coalesce(F.transform("keywords", lambda x: F.lower(x)), F.array().cast("array<string>"))
    v = T.extend_unique([F.array(F.lower("title")), k, F.transform(F.slice(k, 1, 1), lambda x: F.concat(F.lower("title"), F.lit(" "), x))], 8)
    return p.select("publication_id", F.posexplode(v).alias("p", "variant")).select("publication_id", (F.col("p") + 1).cast("bigint").alias("position"), "variant")


def q13_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property rows of all cards: name, value and unit of every parameter that names itself."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"]).select("procedure_summary_id", F.posexplode("process_parameters").alias("p", "m"))
    g = lambda k: F.coalesce(F.element_at("m", F.lit(k)), F.lit(""))
    return p.where(F.element_at("m", F.lit("name")).isNotNull()).select("procedure_summary_id", F.col("p").cast("bigint").alias("position"), g("name").alias("name"), g("value").alias("value"), g("unit").alias("unit"))


def q16_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each query: its three best hits as numbered lines, cut to eighty characters."""
    r = table(spark, sf_dir, "retrieval_results").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank", "result_id"))).where("r <= 3")
    line = F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), T.compact(F.col("text"), 80))
    return r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def q19_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, titled hits and caps of each route of a query."""
    r = table(spark, sf_dir, "retrieval_results")
    g = r.groupBy("query_id", "source_type").agg(F.count("*").alias("hits"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("titled"))
    return g.withColumn("shown", F.least("hits", F.when(F.col("source_type") == "raw_chunk", 20).otherwise(40).cast("bigint")))


def m2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that speak of wanted subjects, by how much they do."""
    d = table(spark, sf_dir, "documents").select("source", F.lower("text").alias("t"))
    want = F.col("t").contains("price") | F.col("t").contains("premium") | F.col("t").contains("цен")
    g = d.groupBy("source").agg(F.count_if(want).alias("hits"), F.count("*").alias("documents"))
    return g.where("hits > 0").orderBy(F.desc("hits"), "source").limit(10)


def d1_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline record of every document from the whole text alone: title, years, first DOI and e-mail, kind, language, what the title rests on, and a confidence for it."""
    d = table(spark, sf_dir, "documents")
    lower = F.lower("text")
    years = F.array_sort(T.matches(F.col("text"), T.YEAR, 1))
    real = F.coalesce(F.nullif(T.collapse(F.col("title")), F.lit("")), F.lit("")) != ""
    first = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(""))
    kind = F.when(F.col("section_kind").contains("table"), "table").when(F.length("text") < 200, "note").otherwise("text")
    x = d.select(
        "doc_id", T.compact(F.when(real, F.col("title")).otherwise(F.col("text")), 80).alias("title"), F.when(real, "title").otherwise("text").alias("evidence"), F.when(real, 550000).otherwise(350000).cast("bigint").alias("confidence"), years.alias("y"),
        first(F.regexp_replace(F.regexp_extract(lower, f"({T.DOI})", 1), "[.,;)]+$", "")).alias("doi"), first(F.regexp_extract(lower, f"({T.EMAIL})", 1)).alias("email"), kind.alias("kind"), T.script_language(F.col("text")).alias("language"),
    )
    return x.select("doc_id", "title", "evidence", "confidence", F.coalesce(F.try_element_at("y", F.lit(-1)), F.lit("")).alias("last_year"), F.size("y").cast("bigint").alias("years"), "doi", "email", "kind", "language")


REFUSAL = r"(?i)(cannot (help|assist)|can't (help|assist)|не могу помочь|as a language model)"


def json_object(x: F.Column) -> F.Column:
    """The JSON object within text, or null: without fences, from the first brace to the last one; nested objects are part of it."""
    body = F.regexp_extract(F.regexp_replace(x, r"```(?:json)?", " "), r"(?s)(\{.*\})", 1)
    return F.when((body != "") & F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull(), body)  # in brackets, as a parser stops at the end of a lone object


def d4_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects recovered from answers: fenced, nested, with text around them, broken or refused."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    k = F.col("event_id") % 5
    s = F.when(k == 0, F.concat(F.lit("answer: "), "props", F.lit("}"))).when(k == 1, F.concat(F.lit('Here is it:\n```json\n{"outer": '), "props", F.lit("}\n```\n"))).when(k == 2, F.lit("I cannot help with that.")).otherwise(F.concat(F.lit("answer: "), "props", F.lit(" end")))
    x = e.select("event_id", s.alias("s")).select("event_id", json_object(F.col("s")).alias("j"), F.col("s").rlike(REFUSAL).alias("refused"))
    status = F.when(F.col("j").isNotNull(), "ok").when(F.col("refused"), "refused").otherwise("parse_failed")
    return x.select("event_id", status.alias("status"), F.coalesce(F.length("j"), F.lit(0)).cast("bigint").alias("chars"))


def d6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of six record families by document kind; venues and evidence (retrieved chunks) go by their documents."""
    p = table(spark, sf_dir, "publications")
    kinds = p.groupBy("doc_id").agg(F.max("document_kind").alias("kind"))
    parts = []
    for f in ("publications", "publication_authors", "procedure_summaries", "retrieval_results", "parsed_tables"):
        n = table(spark, sf_dir, f).groupBy("doc_id").agg(F.count("*").alias("n"))
        parts.append(n.join(kinds, "doc_id").groupBy("kind").agg(F.sum("n").alias("n")).select(F.lit(f).alias("family"), "kind", "n"))
    venues = p.where("venue_name is not null").select(F.col("document_kind").alias("kind"), T.normalise(F.col("venue_name")).alias("v")).groupBy("kind").agg(F.count_distinct("v").alias("n"))
    out = venues.select(F.lit("venues").alias("family"), "kind", "n")
    for x in parts:
        out = out.union(x)
    return out


def d13_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences as grades from 1 to 5 with a verdict."""
    p = table(spark, sf_dir, "procedure_summaries").select("procedure_summary_id", F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("confidence") * 5))).cast("bigint").alias("grade")).distinct()
    return p.withColumn("verdict", F.when(F.col("grade") >= 4, "good").when(F.col("grade") == 3, "usable").otherwise("weak"))


# What an experiment's edge to an entity of each type is called.
BUNDLE = {"material": "uses_material", "process": "operates_at_condition", "equipment": "operates_at_condition", "method": "operates_at_condition", "facility": "operates_at_condition", "property": "produces_output"}


def g3_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each procedure by type: to what it uses, the conditions it runs at, what it produces, and the publication that describes it."""
    m = _mentions(spark, sf_dir)
    kind = F.create_map(*(F.lit(x) for pair in BUNDLE.items() for x in pair))[F.col("type")]
    source = F.concat(F.lit("experiment_"), "seq")
    uses = m.select(source.alias("source_id"), G.node_id(F.col("type"), F.col("label")).alias("target_id"), kind.alias("type"), "seq")
    told = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"]).select(F.concat(F.lit("experiment_"), "procedure_summary_id").alias("source_id"), F.col("publication_id").alias("target_id"), F.lit("described_in").alias("type"), F.col("procedure_summary_id").alias("seq"))
    return G.merge_edges(uses.unionByName(told)).groupBy("source_id", "type").agg(F.count("*").alias("edges"), F.sum("mentions").alias("mentions"))


def v3_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of the retrieved chunks would state: rows that can stand in it, rows left out for a missing id or text, and a digest of (id, document, text) that doesn't depend on the order of rows."""
    r = table(spark, sf_dir, "retrieval_results")
    full = (F.coalesce("chunk_id", F.lit("")) != "") & (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", F.col("result_id").cast("string"), "chunk_id", "doc_id", "text")), 1, 12), 16, 10).cast("bigint")
    return r.select(full.alias("full"), F.when(full, h).alias("h"), "chunk_id").agg(F.count_if("full").alias("count"), F.count_if(~F.col("full")).alias("left_out"), F.count_distinct(F.when(F.col("full"), F.col("chunk_id"))).alias("chunks"), F.bit_xor("h").alias("digest"))


def v4_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of titles; rows only, as the hash is in no SQL engine."""
    return embedding.hashed(table(spark, sf_dir, "publications").where("title is not null"), "publication_id", "title", 64)


QUERIES = {
    f.__name__: f
    for f in (x7_signals, x9_confidence, x12_rule_boost, x13_literature, x14_venue_class, x15_labels, x18_kind, q1_intents, q2_variants, q13_properties, q16_messages, q19_sections, m2_sources, d1_bundle, d4_json, d6_counts, d13_verdicts, g3_bundles, v3_manifest, v4_hash_embedding)
}

_MICRO = "CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"
_COLLAPSE = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_TOK = r"list_filter(list_transform(regexp_extract_all({n}, '[\p{{L}}\p{{N}}_.+#%-]+'), lambda t: regexp_replace(t, '^[.+#%_-]+|[.+#%_-]+$', '', 'g')), lambda t: length(t) >= 2)"
_ONE = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1)"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _alias(names: list[str]) -> str:
    out = []
    for a in names:
        out.append(f"list_contains(k, '{a}')" if len(a) <= 3 and a.isascii() else f"contains(t, '{a}')" if " " in a or "-" in a else f"len(list_filter(k, lambda z: starts_with(z, '{a}'))) > 0")
    return f"CASE WHEN {' OR '.join(out)} THEN 1 ELSE 0 END"


def _cut(x: str, n: int) -> str:
    c = _COLLAPSE.format(x=x)
    return rf"CASE WHEN length({c}) > {n} THEN regexp_replace(substr({c}, 1, {n - 3}), '\s+$', '') || '...' ELSE {c} END"


_NI = "(contains(t, 'nickel') OR contains(t, 'никел'))"
SQL = {
    "x7_signals": f"""WITH n AS (SELECT DISTINCT publication_id, {norm('title')} AS t, {_TOK.format(n=norm('title'))} AS k FROM publications WHERE title IS NOT NULL),
        s AS (SELECT publication_id, len(list_filter([{_quoted(PHRASES)}], lambda q: contains(t, q)))::BIGINT AS phrases, ({' + '.join(_alias(v) for v in CONCEPTS.values())})::BIGINT AS concepts, len(list_filter([{_quoted(FIELDS)}], lambda q: list_contains(k, q)))::BIGINT AS fields FROM n),
        r AS (SELECT *, {_MICRO.format(x=f'least(1.0::DOUBLE, phrases / 4.0::DOUBLE) * 0.08::DOUBLE + concepts / {len(CONCEPTS)}.0::DOUBLE * 0.12::DOUBLE + least(1.0::DOUBLE, fields / {len(FIELDS)}.0::DOUBLE) * 0.04::DOUBLE')} AS score FROM s) SELECT * FROM r WHERE score > 0""",
    "x9_confidence": f"SELECT publication_id, extracted_at, {_MICRO.format(x='least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(confidence, 0.5) + least(0.4::DOUBLE, 0.1::DOUBLE * coalesce(len(keywords), 0))))')} AS confidence FROM publications",
    "x12_rule_boost": f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT doc_id, CASE WHEN {_NI} THEN 2.0 ELSE 0.0 END + CASE WHEN (contains(t, 'nickel') AND contains(t, 'ore')) OR (contains(t, 'никел') AND contains(t, 'руд')) THEN 2.0 ELSE 0.0 END - CASE WHEN (contains(t, 'copper') OR contains(t, 'меди')) AND NOT {_NI} THEN 2.5 ELSE 0.0 END AS b FROM t)
        SELECT doc_id, {_MICRO.format(x='b')} AS boost FROM b WHERE b <> 0""",
    "x13_literature": rf"""WITH o AS (SELECT oa_id, coalesce({norm('title')}, '') AS t, coalesce(try_cast(regexp_extract(year, '((19|20)[0-9]{{2}})', 1) AS INT), 2000) AS y, coalesce(doi, '') <> '' AS d, coalesce(open_access, false) AS a FROM open_access_results),
        s AS (SELECT oa_id, {_MICRO.format(x=f"len(list_filter([{_quoted(FIELDS)}], lambda q: contains(t, q))) * 5 + CASE WHEN d THEN 1 ELSE 0 END + greatest(0, y - 2000) / 100.0::DOUBLE + CASE WHEN a THEN 0.5 ELSE 0.0 END")} AS score FROM o) SELECT * FROM s ORDER BY score DESC, oa_id LIMIT 30""",
    "x14_venue_class": f"""WITH p AS (SELECT publication_id, any_value({norm('venue_name')}) AS v FROM publications GROUP BY ALL), n AS (SELECT v, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL)
        SELECT publication_id, CASE WHEN n IS NULL THEN 'none' WHEN n >= 50 THEN 'A' WHEN n >= 20 THEN 'B' ELSE 'C' END AS venue_class FROM p LEFT JOIN n ON p.v = n.v""",
    "x15_labels": "WITH p AS (SELECT result_id, least(98, greatest(5, floor(score * 100 + 0.5)))::BIGINT AS percent FROM retrieval_results) SELECT *, CASE WHEN percent >= 75 THEN 'high' WHEN percent >= 45 THEN 'medium' ELSE 'low' END AS label FROM p",
    "x18_kind": "SELECT DISTINCT publication_id, CASE WHEN lower(extension) IN ('.xls', '.xlsx', '.csv') THEN 'table' WHEN lower(extension) IN ('.ppt', '.pptx') THEN 'slides' WHEN contains(lower(source_type), 'конференц') THEN 'conference' WHEN lower(extension) = '.pdf' THEN 'article' ELSE 'text' END AS kind FROM publications",
    "q1_intents": "WITH p AS (SELECT DISTINCT publication_id, lower(title) AS l, " + norm("title") + " AS t, " + _TOK.format(n=norm("title")) + " AS k FROM publications WHERE title IS NOT NULL), i AS (SELECT publication_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in INTENTS)
        + " ELSE 'search' END AS intent, concat_ws(','," + ", ".join(f"CASE WHEN ({_alias(v)}) = 1 THEN '{c}' END" for c, v in CONCEPTS.items()) + ") AS concepts, l FROM p), y AS (SELECT *, regexp_extract_all(l, '(19[5-9][0-9]|20[0-2][0-9]|203[0-5])', 1) AS y FROM i)"
        + " SELECT publication_id, intent, concepts, array_to_string(list_filter(y, lambda v, j: list_position(y, v) = j), ',') AS years, CASE WHEN intent IN ('compare', 'table') THEN 'table' WHEN intent = 'expert' THEN 'list' ELSE 'text' END AS answer FROM y",
    "q2_variants": """WITH p AS (SELECT publication_id, any_value(lower(title)) AS t, any_value(coalesce(list_transform(keywords, lambda x: lower(x)), [])) AS k FROM publications WHERE title IS NOT NULL GROUP BY ALL), l AS (SELECT publication_id, list_concat([t], k, list_transform(k[1:1], lambda x: t || ' ' || x)) AS l FROM p),
        e AS (SELECT publication_id, unnest(l) AS variant, generate_subscripts(l, 1) AS i FROM l), f AS (SELECT publication_id, variant, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT publication_id, row_number() OVER (PARTITION BY publication_id ORDER BY i) AS position, variant FROM f) SELECT * FROM r WHERE position <= 8""",
    "q13_properties": f"""WITH {_ONE}, e AS (SELECT procedure_summary_id, unnest(process_parameters) AS m, generate_subscripts(process_parameters, 1) - 1 AS position FROM p) SELECT procedure_summary_id, position::BIGINT AS position, m['name'] AS name, coalesce(m['value'], '') AS value, coalesce(m['unit'], '') AS unit FROM e WHERE m['name'] IS NOT NULL""",
    "q16_messages": f"WITH r AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, result_id) AS r FROM retrieval_results) SELECT query_id, string_agg('[' || r || '] ' || ({_cut('text', 80)}), chr(10) ORDER BY r) AS context FROM r WHERE r <= 3 GROUP BY ALL",
    "q19_sections": "WITH g AS (SELECT query_id, source_type, count(*) AS hits, count(*) FILTER (WHERE coalesce(title, '') <> '') AS titled FROM retrieval_results GROUP BY ALL) SELECT *, least(hits, CASE WHEN source_type = 'raw_chunk' THEN 20 ELSE 40 END)::BIGINT AS shown FROM g",
    "m2_sources": "WITH g AS (SELECT source, count(*) FILTER (WHERE contains(lower(text), 'price') OR contains(lower(text), 'premium') OR contains(lower(text), 'цен')) AS hits, count(*) AS documents FROM documents GROUP BY ALL) SELECT * FROM g WHERE hits > 0 ORDER BY hits DESC, source LIMIT 10",
    "d1_bundle": rf"""WITH d AS (SELECT doc_id, text, lower(text) AS l, nullif({_COLLAPSE.format(x='title')}, '') IS NOT NULL AS real, title, section_kind, list_sort(list_distinct(regexp_extract_all(text, '(19[5-9][0-9]|20[0-2][0-9]|203[0-5])', 1))) AS y, length(regexp_replace(lower(text), '[^а-яё]', '', 'g')) AS ru, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS en FROM documents),
        e AS (SELECT *, CASE WHEN real THEN title ELSE text END AS x FROM d)
        SELECT doc_id, {_cut('x', 80)} AS title, CASE WHEN real THEN 'title' ELSE 'text' END AS evidence, (CASE WHEN real THEN 550000 ELSE 350000 END)::BIGINT AS confidence, coalesce(y[-1], '') AS last_year, coalesce(len(y), -1)::BIGINT AS years, coalesce(regexp_replace(regexp_extract(l, '(10\.[0-9]{{4,9}}/[^\s"<>]+)', 1), '[.,;)]+$', ''), '') AS doi,
        coalesce(regexp_extract(l, '([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}})', 1), '') AS email, CASE WHEN contains(section_kind, 'table') THEN 'table' WHEN length(text) < 200 THEN 'note' ELSE 'text' END AS kind,
        CASE WHEN text IS NULL OR greatest(ru, en) = 0 THEN 'unknown' WHEN least(ru, en) / greatest(ru, en) > 0.2 THEN 'mixed' WHEN ru > en THEN 'ru' ELSE 'en' END AS language FROM e""",
    "d4_json": r"""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'answer: ' || props || '}' WHEN 1 THEN 'Here is it:' || chr(10) || '```json' || chr(10) || '{"outer": ' || props || '}' || chr(10) || '```' || chr(10) WHEN 2 THEN 'I cannot help with that.' ELSE 'answer: ' || props || ' end' END AS s FROM events),
        b AS (SELECT event_id, s, nullif(regexp_extract(regexp_replace(s, '```(?:json)?', ' ', 'g'), '(?s)(\{.*\})', 1), '') AS j FROM e)
        SELECT event_id, CASE WHEN coalesce(json_valid(j), false) THEN 'ok' WHEN contains(s, 'cannot help') THEN 'refused' ELSE 'parse_failed' END AS status, (CASE WHEN coalesce(json_valid(j), false) THEN length(j) ELSE 0 END)::BIGINT AS chars FROM b""",
    "d6_counts": f"SELECT 'venues' AS family, document_kind AS kind, count(DISTINCT {norm('venue_name')}) AS n FROM publications WHERE venue_name IS NOT NULL GROUP BY ALL UNION ALL " + " UNION ALL ".join(f"SELECT '{f}' AS family, kind, count(*) AS n FROM {f} JOIN (SELECT doc_id, max(document_kind) AS kind FROM publications GROUP BY ALL) k USING (doc_id) GROUP BY ALL" for f in ("publications", "publication_authors", "procedure_summaries", "retrieval_results", "parsed_tables")),
    "d13_verdicts": "WITH g AS (SELECT DISTINCT procedure_summary_id, least(5, greatest(1, ceil(confidence * 5)))::BIGINT AS grade FROM procedure_summaries) SELECT *, CASE WHEN grade >= 4 THEN 'good' WHEN grade = 3 THEN 'usable' ELSE 'weak' END AS verdict FROM g",
    "g3_bundles": f"""WITH {_M}, d AS (SELECT 'experiment_' || seq AS source_id, node_id AS target_id, CASE type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BUNDLE.items())} END AS type FROM i UNION ALL SELECT 'experiment_' || procedure_summary_id, publication_id, 'described_in' FROM p),
        e AS (SELECT source_id, target_id, type, count(*) AS mentions FROM d GROUP BY ALL) SELECT source_id, type, count(*) AS edges, sum(mentions)::BIGINT AS mentions FROM e GROUP BY ALL""",
    "v3_manifest": """WITH r AS (SELECT *, coalesce(chunk_id, '') <> '' AND coalesce(doc_id, '') <> '' AND coalesce(text, '') <> '' AS f FROM retrieval_results)
        SELECT count(*) FILTER (WHERE f) AS count, count(*) FILTER (WHERE NOT f) AS left_out, count(DISTINCT chunk_id) FILTER (WHERE f) AS chunks, bit_xor(('0x' || substr(sha1(concat_ws('|', result_id::VARCHAR, chunk_id, doc_id, text)), 1, 12))::BIGINT) FILTER (WHERE f) AS digest FROM r""",
}
