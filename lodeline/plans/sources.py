"""Scans, sinks and shapes of source records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators.prefix import running_sum
from lodeline.runtime import table
from lodeline.sources import files


def s12_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as cells of a sheet: null as empty, whole numbers without fraction, days as ISO, truth in capitals."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_totalprice") == F.floor("o_totalprice"), F.floor("o_totalprice").cast("string")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select("o_orderkey", F.coalesce(price, F.lit("")).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("FALSE").alias("done"))


def s15_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets out of the JSON of every document with tables: documents without an id, broken JSON and sheets that are no objects give nothing, counts that are no numbers are 0, paths start after the root."""
    t = table(spark, sf_dir, "parsed_tables").select("doc_id", "table_id", "page_or_sheet", "row_count", "local_path")
    sheet = F.struct(F.lit("1").alias("sheet_index"), F.coalesce("page_or_sheet", F.lit("")).alias("sheet_name"), F.coalesce(F.col("row_count").cast("string"), F.lit("many")).alias("rows"), F.lit("x").alias("columns"), F.concat(F.lit("C:\\data\\parsed\\spreadsheets_csv\\"), "local_path").alias("csv_path"))
    whole = F.to_json(F.struct(F.array(sheet).alias("sheets")))
    broken = F.pmod(F.length("table_id") + F.ascii(F.substring("table_id", -1, 1)), F.lit(5)) == 0
    docs = t.select(F.concat_ws(":", "doc_id", "table_id").alias("doc_id"), F.when(broken, F.substring(whole, 1, 20)).otherwise(whole).alias("metadata_json"))
    return files.explode_sheets(docs)


def s16_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three rows of each table, its first four cells, trimmed."""
    t = table(spark, sf_dir, "parsed_tables").select("table_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("p", "row"))
    cells = F.transform(F.slice(F.split("row", r"[|;\t]"), 1, 4), lambda x: F.trim(x))
    return t.select("table_id", (F.col("p") + 1).cast("bigint").alias("row_no"), F.array_join(cells, " | ").alias("cells"))


def s18_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred files taken from the folders in turn, small kinds first."""
    p = table(spark, sf_dir, "publications").select("publication_id", "source_type", F.lower("extension").alias("x"), F.length("source_path").alias("n")).distinct()
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("source_type").orderBy("x", "n", "publication_id")))
    return r.where("r <= 100").orderBy("r", "source_type").limit(100).select("publication_id", "source_type", F.col("r").cast("bigint").alias("round"))


def s20_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with those of one source replaced by derived ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("chars"))
    old = d.where("source = 'newsroom'")
    derived = old.select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("derived").alias("source"), "chars")
    return d.join(old, "doc_id", "left_anti").unionByName(derived)


def s21_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications without any procedure card yet."""
    p = table(spark, sf_dir, "publications").select("publication_id").distinct()
    return files.resume(p, table(spark, sf_dir, "procedure_summaries"), "publication_id")


def s23_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last extraction of each publication laid over all of them."""
    p = table(spark, sf_dir, "publications").select("publication_id", "confidence", "extracted_at")
    w = Window.partitionBy("publication_id")
    twice = p.withColumn("n", F.count("*").over(w)).withColumn("last", F.max("extracted_at").over(w)).where("n > 1 and extracted_at = last").drop("n", "last")
    return files.upsert(p, twice, "publication_id")


def s24_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without markup and entities."""
    t = F.col("title")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return table(spark, sf_dir, "open_access_results").where("title is not null").select("oa_id", T.collapse(t).alias("title"))


# Ranges of addresses that aren't public, and what addresses in them begin with.
PRIVATE = r"^(localhost$|.*\.localhost$|0\.|127\.|10\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|169\.254\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|172\.(1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|2[3-5][0-9]\.)"
PRIVATE_6 = r"^\[(::|::1|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)\]$"
ODD_NUMBER = r"^(0x[0-9a-f]+|[0-9]+|[0-9.]*0x[0-9a-fx.]*|0[0-7]+\..*)$"


def url_gate(u: F.Column) -> F.Column:
    """Whether a page may be fetched: https, no user part, no private, loopback, link-local, multicast or reserved address in any notation.

    A redirect's target is another URL and goes through the same gate.
    """
    host = url_host(u)
    return (
        F.when(u.isNull() | (F.trim(u) == ""), "missing").when(~F.lower(u).startswith("https://"), "not_https").when(u.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "user_part")
        .when(host == "", "no_host").when(host.rlike(PRIVATE) | host.rlike(PRIVATE_6) | host.rlike(ODD_NUMBER), "private").otherwise("ok")
    )


def url_host(u: F.Column) -> F.Column:
    """Host in lower case, an IPv6 address in its brackets; a final dot doesn't count."""
    return F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), r"\.$", "")


def s25_url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over every landing page and every link to a PDF, and over addresses built into each page's link in the notations that are no public host."""
    o = table(spark, sf_dir, "open_access_results").select("oa_id", "landing_page_url", "best_pdf_url", F.coalesce("oa_id", F.lit("")).alias("x"))
    odd = [F.concat(F.lit(f"https://{h}/"), "x").alias("u") for h in ODD_HOSTS]
    urls = F.array(F.col("landing_page_url"), F.col("best_pdf_url"), *odd)
    e = o.select("oa_id", F.posexplode(urls).alias("p", "u"))
    return e.select("oa_id", F.col("p").cast("bigint").alias("link"), url_gate(F.col("u")).alias("gate"), F.coalesce(url_host(F.col("u")), F.lit("")).alias("host"))


ODD_HOSTS = ("[::1]", "0.0.0.0", "224.0.0.1", "[fe80::1]", "2130706433", "100.64.1.1", "example.org.", "user@example.org")


def s27_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-access records in one shape: bare DOI, year as a number, best link."""
    o = table(spark, sf_dir, "open_access_results")
    doi = F.nullif(F.regexp_replace(F.regexp_extract(F.replace(F.lower("doi"), F.lit("%2f"), F.lit("/")), r"(10\.[0-9]{4,9}/\S+)", 1), r"[.,;)]+$", ""), F.lit(""))
    return o.select("oa_id", doi.alias("doi"), F.expr("try_cast(regexp_extract(year, '((19|20)[0-9]{2})', 1) as bigint)").alias("year"), F.coalesce(F.nullif("best_pdf_url", F.lit("")), "landing_page_url", F.concat(F.lit("doi:"), doi), F.lit("")).alias("link"))


# Names that file systems keep for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)))


def s30_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names without characters that file systems refuse."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce("title", "file_name"), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")
    return table(spark, sf_dir, "publications").select("publication_id", F.substring(F.when(F.upper(F.regexp_extract(x, r"^([^.]*)", 1)).isin(*RESERVED, ""), F.concat(F.lit("_"), x)).otherwise(x), 1, 180).alias("name")).distinct()


def s31_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths relative to the data folder."""
    return table(spark, sf_dir, "parsed_tables").select("table_id", F.regexp_replace(F.replace("local_path", F.lit("\\"), F.lit("/")), r"^.*?data/raw/", "").alias("path"))


def q9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search links of each work at three providers."""
    p = table(spark, sf_dir, "publications").where("doi is not null").select("publication_id", "doi").distinct()
    t = F.array(*(F.struct(F.lit(n).alias("provider"), F.lit(u).alias("u")) for n, u in (("resolver", "https://doi.example/"), ("index", "https://index.example/?q="), ("archive", "https://archive.example/s/"))))
    return p.select("publication_id", F.explode(t).alias("t"), "doi").select("publication_id", "t.provider", F.concat("t.u", F.replace("doi", F.lit("/"), F.lit("%2F"))).alias("url"))


def q15_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with addresses and identifiers hidden."""
    a = table(spark, sf_dir, "publication_authors").where("email is not null or orcid is not null")
    hide = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", "raw_name", "email", "orcid"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[address]"), r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", "[id]")
    return a.select("author_id", hide.alias("line")).distinct()


def q18_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text by kind: heading, list item or paragraph."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.trim("line") != "")
    kind = F.when(F.col("line").rlike(r"^\s*([-*•]|[0-9]{1,3}[.)])\s"), "item").when((F.length("line") < 80) & ~F.col("line").rlike(r"[.!?;:]\s*$"), "heading").otherwise("paragraph")
    return d.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("lines"))


def st_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of an hour."""
    e = table(spark, sf_dir, "events").where("value is not null")
    g = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("bigint").alias("cents"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events no more than thirty minutes apart."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    wide = F.expr("interval 30 minutes")
    days = e.groupBy("user_id", "day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    before = F.lag("last").over(Window.partitionBy("user_id").orderBy("day"))  # a row for each user and day
    opens = days.select("user_id", "day", F.coalesce((F.col("first") - before > wide).cast("bigint"), F.lit(0)).alias("opens"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w)
    x = e.withColumn("gap", F.when(gap.isNull(), F.lit(None)).otherwise((F.col("ts") - gap > wide).cast("bigint"))).join(opens, ["user_id", "day"])
    x = x.withColumn("new", F.coalesce("gap", "opens"))
    s = running_sum(x, ["user_id"], "day", [F.col("ts"), F.col("event_id")], "new", "session")
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (s12_cells, s15_json, s16_preview, s18_round_robin, s20_replaced, s21_resume, s23_upsert, s24_markup, s25_url_gate, s27_normalised, s30_safe_names, s31_portable, q9_links, q15_redacted, q18_lines, st_windows, st_sessions)}

_DOI = r"nullif(regexp_replace(regexp_extract(replace(lower(doi), '%2f', '/'), '(10\.[0-9]{4,9}/\S+)', 1), '[.,;)]+$', ''), '')"
_HOST = r"lower(regexp_extract(landing_page_url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1))"
_NAME = r"""regexp_replace(regexp_replace(coalesce(title, file_name), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[ .]+$', '')"""
SQL = {
    "s12_cells": "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice = floor(o_totalprice) THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END, '') AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END AS done FROM orders",
    "s15_json": r"""SELECT concat_ws(':', doc_id, table_id) AS doc_id, 1 AS sheet_index, coalesce(page_or_sheet, '') AS sheet_name, coalesce(row_count, 0)::INT AS rows, 0 AS columns, replace(local_path, '\', '/') AS csv_path FROM parsed_tables WHERE (length(table_id) + ascii(table_id[-1])) % 5 <> 0""",
    "s16_preview": r"""WITH r AS (SELECT table_id, unnest(string_split(text, chr(10))[1:3]) AS row, generate_subscripts(string_split(text, chr(10))[1:3], 1)::BIGINT AS row_no FROM parsed_tables) SELECT table_id, row_no, array_to_string(list_transform(regexp_split_to_array(row, '[|;\t]')[1:4], lambda x: trim(x)), ' | ') AS cells FROM r""",
    "s18_round_robin": "WITH p AS (SELECT DISTINCT publication_id, source_type, lower(extension) AS x, length(source_path) AS n FROM publications), r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY x, n, publication_id) AS r FROM p) SELECT publication_id, source_type, r AS round FROM r ORDER BY r, source_type LIMIT 100",
    "s20_replaced": "SELECT doc_id, source, length(text) AS chars FROM documents WHERE source <> 'newsroom' UNION ALL SELECT doc_id + 1000000, 'derived', length(text) FROM documents WHERE source = 'newsroom'",
    "s21_resume": "SELECT DISTINCT publication_id FROM publications WHERE publication_id NOT IN (SELECT publication_id FROM procedure_summaries WHERE publication_id IS NOT NULL)",
    "s23_upsert": "WITH p AS (SELECT publication_id, confidence, extracted_at, count(*) OVER (PARTITION BY publication_id) AS n, max(extracted_at) OVER (PARTITION BY publication_id) AS last FROM publications) SELECT publication_id, confidence, extracted_at FROM p WHERE n = 1 OR extracted_at = last",
    "s24_markup": r"""WITH t AS (SELECT oa_id, replace(replace(replace(replace(replace(title, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' ') AS t FROM open_access_results WHERE title IS NOT NULL), u AS (SELECT oa_id, regexp_replace(regexp_replace(t, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM t)
        SELECT oa_id, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^ | $', '', 'g') AS title FROM u""",
    "s25_url_gate": rf"""WITH a AS (SELECT oa_id, [landing_page_url, best_pdf_url, {', '.join(f"'https://{h}/' || coalesce(oa_id, '')" for h in ODD_HOSTS)}] AS l FROM open_access_results), e AS (SELECT oa_id, unnest(l) AS u, generate_subscripts(l, 1) - 1 AS link FROM a),
        h AS (SELECT oa_id, link, u, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '\.$', '') AS host FROM e)
        SELECT oa_id, link::BIGINT AS link, CASE WHEN u IS NULL OR trim(u) = '' THEN 'missing' WHEN NOT starts_with(lower(u), 'https://') THEN 'not_https' WHEN regexp_matches(u, '^[a-zA-Z]+://[^/?#]*@') THEN 'user_part' WHEN host = '' THEN 'no_host'
        WHEN regexp_matches(host, '{PRIVATE}') OR regexp_matches(host, '{PRIVATE_6}') OR regexp_matches(host, '{ODD_NUMBER}') THEN 'private' ELSE 'ok' END AS gate, coalesce(host, '') AS host FROM h""",
    "s27_normalised": f"SELECT oa_id, {_DOI} AS doi, try_cast(regexp_extract(year, '((19|20)[0-9]{{2}})', 1) AS BIGINT) AS year, coalesce(nullif(best_pdf_url, ''), landing_page_url, 'doi:' || {_DOI}, '') AS link FROM open_access_results",
    "s30_safe_names": f"SELECT DISTINCT publication_id, substr(CASE WHEN upper(regexp_extract({_NAME}, '^([^.]*)', 1)) IN ({', '.join(f"'{x}'" for x in RESERVED)}, '') THEN '_' || {_NAME} ELSE {_NAME} END, 1, 180) AS name FROM publications",
    "s31_portable": r"SELECT table_id, regexp_replace(replace(local_path, '\', '/'), '^.*?data/raw/', '') AS path FROM parsed_tables",
    "q9_links": "WITH p AS (SELECT DISTINCT publication_id, doi FROM publications WHERE doi IS NOT NULL) SELECT publication_id, provider, u || replace(doi, '/', '%2F') AS url FROM p, (VALUES ('resolver', 'https://doi.example/'), ('index', 'https://index.example/?q='), ('archive', 'https://archive.example/s/')) v(provider, u)",
    "q15_redacted": r"SELECT DISTINCT author_id, regexp_replace(regexp_replace(concat_ws(' ', raw_name, email, orcid), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[address]', 'g'), '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]', '[id]', 'g') AS line FROM publication_authors WHERE email IS NOT NULL OR orcid IS NOT NULL",
    "q18_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*([-*•]|[0-9]{1,3}[.)])\s') THEN 'item' WHEN length(line) < 80 AND NOT regexp_matches(line, '[.!?;:]\s*$') THEN 'heading' ELSE 'paragraph' END AS kind, count(*) AS lines FROM l WHERE trim(line) <> '' GROUP BY ALL""",
    "st_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(floor(value * 100 + 0.5))::BIGINT AS cents FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "st_sessions": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, min(ts) AS start, count(*) AS events FROM s GROUP BY ALL",
}
