"""Entity graphs built from the tables, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import graph as G
from lodeline.plans.text import norm
from lodeline.runtime import table


# Node types of a card's entities, and the fields that name them.
ENTITY_FIELDS = (("material", "materials"), ("process", "processes"), ("equipment", "equipment"))
SINGLE_FIELDS = (("method", "synthesis_or_process_method"), ("facility", "scale"), ("material", "material_name"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_id, seq, type, label) of the entities that procedure cards name: lists, single fields, and properties by their parameters' names."""
    p = table(spark, sf_dir, "procedure_summaries").dropDuplicates(["procedure_summary_id"])
    named = lambda t: lambda x: F.struct(F.lit(t).alias("type"), x.alias("label"))
    many = [F.transform(c, named(t)) for t, c in ENTITY_FIELDS]
    one = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("label")) for t, c in SINGLE_FIELDS))
    names = F.transform("process_parameters", lambda m: F.struct(F.lit("property").alias("type"), F.element_at(m, "name").alias("label")))
    none = F.array().cast("array<struct<type:string,label:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in (*many, one, names)))
    e = p.select("publication_id", F.col("procedure_summary_id").alias("seq"), F.explode(every).alias("e"))
    return e.select("publication_id", "seq", "e.type", "e.label").where("label <> ''")


def g2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    return G.merge_nodes(m.select(G.node_id(F.col("type"), F.col("label")).alias("node_id"), "type", "label", "seq"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    return m.select(F.col("publication_id").alias("source_id"), G.node_id(F.col("type"), F.col("label")).alias("target_id"), F.concat(F.lit("uses_"), "type").alias("type"), "seq")


def g6_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "publications").select(F.col("publication_id").alias("node_id")).distinct()
    n = g2_nodes(spark, sf_dir).select("node_id").unionByName(p)
    return G.merge_edges(_edges(spark, sf_dir), n).select("edge_id", "source_id", "target_id", "type", "mentions")


def g1_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert to publication edges."""
    a = table(spark, sf_dir, "publication_authors").where("role <> 'organization'")
    e = a.select(G.node_id("expert", F.col("raw_name")).alias("source_id"), F.col("publication_id").alias("target_id"), F.lit("authored").alias("type"), F.col("author_id").alias("seq"))
    return G.merge_edges(e).select("edge_id", "source_id", "target_id", "mentions")


def g4_table_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "parsed_tables")
    return t.select(F.concat(F.lit("table_"), F.substring(F.sha1("table_id"), 1, 16)).alias("node_id"), F.concat(F.lit("pub_"), "doc_id").alias("publication_id"), F.coalesce("page_or_sheet", F.lit("")).alias("label"))


def g5_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose pattern occurs in a title."""
    tags = {"nickel": "никел|nickel|nickel|níquel", "copper": "copper|медн|cuivre|cobre|kupfer", "slag": "slag|шлак|scorie|escoria|schlacke"}
    p = table(spark, sf_dir, "publications").select("publication_id", F.lower("title").alias("t")).distinct()
    hit = F.array_compact(F.array(*(F.when(F.col("t").rlike(x), F.lit(k)) for k, x in tags.items())))
    return p.select("publication_id", F.explode(hit).alias("entity"))


def g7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by how many of the terms their label holds, exact labels first."""
    terms = ["flotation", "cell", "печь", "furnace"]
    n = g2_nodes(spark, sf_dir).withColumn("l", T.normalise(F.col("label")))
    score = sum((F.col("l").contains(t).cast("int") for t in terms), F.lit(0)) + F.when(F.col("l").isin(terms), 1).otherwise(0)
    return n.select("node_id", "type", "label", score.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), "node_id").limit(30)


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of nations, regions, suppliers and customers."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    e = [
        n.select(key("n", "n_nationkey").alias("source_id"), key("r", "n_regionkey").alias("target_id"), F.lit("in_region").alias("type")),
        s.select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("supplies_from")),
        c.select(key("c", "c_custkey"), key("n", "c_nationkey"), F.lit("buys_in")),
    ]
    return e[0].union(e[1]).union(e[2])


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge: all customers, and the publications' entities."""
    return _geo(spark, sf_dir).unionByName(g6_edges(spark, sf_dir).select("source_id", "target_id", "type"))


def _hundredth(edges: DataFrame) -> DataFrame:
    """Nations, regions, suppliers and customers whose key is divisible by 100."""
    nodes = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.where(F.col("node_id").rlike("^[nrsc](0|[0-9]*00)$"))


def g8_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_whole(spark, sf_dir))


def g8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _whole(spark, sf_dir)
    return G.neighbours(e, _hundredth(e))


def g9_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of up to three edges from every hundredth node, with all customers."""
    e = _geo(spark, sf_dir)
    p = G.paths(e, _hundredth(e), 3)
    return p.select("start_id", "end_id", F.col("label").alias("path"), F.col("depth").cast("bigint").alias("depth"))


def g11_mini_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the twenty most used entities only, the strongest ones."""
    e = g6_edges(spark, sf_dir)
    top = e.groupBy("target_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_id").limit(20)
    r = e.join(F.broadcast(top), "target_id").withColumn("r", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("mentions"), "source_id")))  # twenty ids
    return r.where("r <= 6").select("source_id", "target_id", "type", "mentions")


QUERIES = {f.__name__: f for f in (g1_authored, g2_nodes, g4_table_nodes, g5_tags, g6_edges, g7_entities, g8_degrees, g8_neighbours, g9_paths, g11_mini_graph)}

_P = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_summary_id) AS k FROM procedure_summaries) WHERE k = 1)"
_FIELDS = " UNION ALL ".join([f"SELECT publication_id, procedure_summary_id AS seq, '{t}' AS type, unnest({c}) AS label FROM p" for t, c in ENTITY_FIELDS] + [f"SELECT publication_id, procedure_summary_id, '{t}', {c} FROM p" for t, c in SINGLE_FIELDS])
_M = f"""{_P}, v AS (SELECT publication_id, procedure_summary_id AS seq, unnest(process_parameters) AS q FROM p), m AS ({_FIELDS} UNION ALL SELECT publication_id, seq, 'property', q['name'] FROM v),
    i AS (SELECT *, type || '_' || substr(sha1({norm('label')}), 1, 16) AS node_id FROM m WHERE label <> '')"""
_E = f"""{_M}, e AS (SELECT 'edge_' || substr(sha1(publication_id || '|uses_' || type || '|' || node_id), 1, 20) AS edge_id, publication_id AS source_id, node_id AS target_id, 'uses_' || type AS type, count(*) AS mentions FROM i WHERE publication_id IN (SELECT publication_id FROM publications) GROUP BY ALL)"""
_GEO = """e AS (SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'in_region' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplies_from' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'buys_in' FROM customer),
    b AS (SELECT source_id AS a, target_id AS b, type FROM e UNION ALL SELECT target_id, source_id, 'reverse:' || type FROM e)"""
_ALL = _GEO.replace("e AS (", "geo AS (", 1).split("),\n")[0] + ")"
_BOTH = "b AS (SELECT source_id AS a, target_id AS b, type FROM {x} UNION ALL SELECT target_id, source_id, 'reverse:' || type FROM {x})"
_WHOLE = f"{_E}, {_ALL}, x AS (SELECT * FROM geo UNION ALL SELECT source_id, target_id, type FROM e), {_BOTH.format(x='x')}"
_NODES = "n AS (SELECT node_id, type, arg_min(label, {seq: seq, label: label}) AS label, count(*) AS mentions FROM i GROUP BY ALL)"
SQL = {
    "g1_authored": f"""WITH a AS (SELECT 'expert_' || substr(sha1({norm('raw_name')}), 1, 16) AS source_id, publication_id AS target_id FROM publication_authors WHERE role <> 'organization' AND raw_name IS NOT NULL)
        SELECT 'edge_' || substr(sha1(source_id || '|authored|' || target_id), 1, 20) AS edge_id, source_id, target_id, count(*) AS mentions FROM a GROUP BY ALL""",
    "g2_nodes": f"WITH {_M}, {_NODES} SELECT * FROM n",
    "g4_table_nodes": "SELECT 'table_' || substr(sha1(table_id), 1, 16) AS node_id, 'pub_' || doc_id AS publication_id, coalesce(page_or_sheet, '') AS label FROM parsed_tables",
    "g5_tags": " UNION ALL ".join(f"SELECT DISTINCT publication_id, '{k}' AS entity FROM publications WHERE regexp_matches(lower(title), '{x}')" for k, x in (("nickel", "никел|nickel|níquel"), ("copper", "copper|медн|cuivre|cobre|kupfer"), ("slag", "slag|шлак|scorie|escoria|schlacke"))),
    "g6_edges": f"WITH {_E} SELECT * FROM e",
    "g7_entities": f"""WITH {_M}, {_NODES}, s AS (SELECT node_id, type, label, (len(list_filter(['flotation', 'cell', 'печь', 'furnace'], lambda t: contains({norm('label')}, t))) + CASE WHEN {norm('label')} IN ('flotation', 'cell', 'печь', 'furnace') THEN 1 ELSE 0 END)::BIGINT AS score FROM n)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, node_id LIMIT 30""",
    "g8_degrees": f"WITH {_WHOLE} SELECT a AS node_id, count(*) AS degree, count(DISTINCT b) AS neighbours FROM b GROUP BY ALL",
    "g8_neighbours": f"WITH {_WHOLE} SELECT a AS node_id, type, b AS other FROM b WHERE regexp_matches(a, '^[nrsc](0|[0-9]*00)$')",
    "g9_paths": f"""WITH RECURSIVE {_ALL}, {_BOTH.format(x='geo')}, w AS (SELECT DISTINCT a AS start_id, a AS end_id, [a] AS nodes, a AS path, 0 AS depth FROM b WHERE regexp_matches(a, '^[nrsc](0|[0-9]*00)$')
        UNION ALL SELECT start_id, b.b, list_append(nodes, b.b), path || ' -[' || b.type || ']-> ' || b.b, depth + 1 FROM w JOIN b ON w.end_id = b.a WHERE depth < 3 AND NOT list_contains(nodes, b.b)) SELECT start_id, end_id, path, depth::BIGINT AS depth FROM w WHERE depth > 0""",
    "g11_mini_graph": f"""WITH {_E}, t AS (SELECT target_id FROM e GROUP BY ALL ORDER BY count(*) DESC, target_id LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY mentions DESC, source_id) AS r FROM e WHERE target_id IN (SELECT target_id FROM t))
        SELECT source_id, target_id, type, mentions FROM r WHERE r <= 6""",
}
