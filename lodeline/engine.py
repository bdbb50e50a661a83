"""The engine over a folder of tables: search, and the evidence for an answer.

Streams that lack their table are left out with a diagnostics row; the others still answer.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import index as I  # noqa: E741, N812
from lodeline.operators import search as S
from lodeline.plans import graph
from lodeline.plans.assist import INTENTS
from lodeline.plans.text import CONCEPTS
from lodeline.runtime import table

ROUTES = {"compare": ("raw", "summaries", "tables"), "influence": ("raw", "summaries"), "control": ("raw", "summaries"), "site_study": ("raw", "tables"), "overview": ("summaries", "raw"), "search": ("raw", "summaries", "tables", "graph")}
HIT = "route string, id string, score double, snippet string"


MODES = {"hybrid": ("lexical", "dense"), "lexical": ("lexical",), "dense": ("dense",)}


@dataclass
class Plan:
    """What a question asks for and where to look."""

    query: str
    intent: str
    terms: list[str]
    routes: tuple[str, ...]
    variants: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    years: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)


class Engine:
    """Search over a folder of tables; with ``indexes``, a folder that :meth:`build` wrote, keyword and vector search read stored indexes."""

    def __init__(self, spark: SparkSession, folder: str, k: int = 10, weights: dict[str, float] | None = None, indexes: str | None = None, mode: str = "hybrid", dimension: int = 384):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.spark, self.folder, self.k, self.indexes, self.mode, self.dimension = spark, folder, k, indexes, mode, dimension
        self.weights = {"raw": 1.0, "dense": 1.0, "summaries": 0.8, "tables": 0.6, "graph": 0.4} | (weights or {})

    def build(self) -> dict[str, I.Manifest]:
        """Write the indexes of the documents."""
        if not self.indexes:
            raise ValueError("indexes: the folder to write to isn't given")
        d = table(self.spark, self.folder, "documents")
        return {"lexical": I.build_lexical(d, "doc_id", "text", f"{self.indexes}/lexical"), "vectors": I.build_vectors(d, "doc_id", "text", f"{self.indexes}/vectors", self.dimension)}

    def plan(self, query: str) -> Plan:
        """Intent by the first words that show one, search terms, quoted phrases, years, concepts, routes and variants."""
        low = " ".join(query.lower().split())
        intent = next((n for n, words in INTENTS if any(w in low for w in words)), "search")
        terms = list(dict.fromkeys(w.strip(".,;:?!()\"«»“”") for w in low.split() if len(w.strip(".,;:?!()\"«»“”")) > 2))[:16]
        phrases = [x.strip() for x in re.findall(r"[«“\"]([^«»“”\"]{3,60})[»”\"]", low)]
        concepts = [c for c, names in CONCEPTS.items() if any(t.startswith(a) if len(a) > 3 else t == a for t in terms for a in names)]
        pairs = [" ".join(p) for p in zip(terms, terms[1:])]
        variants = list(dict.fromkeys([low, *phrases, " ".join(terms), *pairs]))[:8]
        return Plan(query, intent, terms, ROUTES[intent], variants, phrases, re.findall(r"\b(?:19|20)\d\d\b", low), concepts)

    def rewrite(self, p: Plan) -> str:
        """A keyword query: phrases and terms, and the names of its concepts as alternatives."""
        parts = [f'"{x}"' for x in p.phrases] + [t for t in p.terms if not any(t in x for x in p.phrases)]
        return " ".join(parts) + "".join(f" ({' OR '.join(CONCEPTS[c])})" for c in p.concepts)

    def _documents(self, best: DataFrame, route: str) -> DataFrame:
        d = table(self.spark, self.folder, "documents").select(F.col("doc_id").alias("row_id"), "text")
        return d.join(F.broadcast(best), "row_id").select(F.lit(route).alias("route"), F.col("row_id").cast("string").alias("id"), "score", T.compact(F.col("text"), 240).alias("snippet"))  # at most k rows

    def _raw(self, p: Plan) -> DataFrame:
        if self.indexes:
            return self._documents(I.bm25(self.spark, f"{self.indexes}/lexical", p.query, self.k), "raw")
        return self._documents(S.bm25(table(self.spark, self.folder, "documents"), "doc_id", "text", p.query, self.k), "raw")

    def _dense(self, p: Plan) -> DataFrame:
        if not self.indexes:
            raise I.Unfit("no vectors: the engine has no folder of indexes")
        return self._documents(I.nearest(self.spark, f"{self.indexes}/vectors", p.query, self.k, self.dimension), "dense")

    def _summaries(self, p: Plan) -> DataFrame:
        """Coverage of the terms, phrases and concepts of the query, in abstracts and cards."""
        a = table(self.spark, self.folder, "publications").select(F.col("publication_id").alias("id"), F.col("abstract").alias("t")).where("t is not null").distinct()
        b = table(self.spark, self.folder, "procedure_summaries").select(F.col("procedure_summary_id").alias("id"), F.col("key_points").alias("t")).where("t is not null").distinct()
        hits = lambda t, xs: sum((t.contains(x).cast("int") for x in xs), F.lit(0))
        s = T.once(T.normalise(F.col("t")), lambda t: T.coverage(t, p.terms) * 10 + 2 * hits(t, p.phrases) + 2.5 * sum(((hits(t, CONCEPTS[c]) > 0).cast("int") for c in p.concepts), F.lit(0)))
        return a.unionByName(b).select(F.lit("summaries").alias("route"), "id", s.alias("score"), T.compact(F.col("t"), 240).alias("snippet")).orderBy(F.desc("score"), "id").limit(self.k).where("score > 0")

    def _tables(self, p: Plan) -> DataFrame:
        rows = S.table_rows(table(self.spark, self.folder, "parsed_tables"), "table_id", "text")
        s = T.once(T.normalise(F.col("row")), lambda t: T.coverage(t, p.terms) * 10)
        return rows.select(F.lit("tables").alias("route"), F.concat_ws(":", "table_id", "row_no").alias("id"), s.alias("score"), T.compact(F.col("row"), 240).alias("snippet")).orderBy(F.desc("score"), "id").limit(self.k).where("score > 0")

    def _graph(self, p: Plan) -> DataFrame:
        """Entities that the terms name, with how many publications use them and the first of those."""
        n = graph.g2_nodes(self.spark, self.folder).withColumn("l", T.normalise(F.col("label")))
        hit = n.select("node_id", "label", T.coverage(F.col("l"), p.terms).alias("c")).where("c > 0").orderBy(F.desc("c"), "node_id").limit(self.k)
        uses = graph.g6_edges(self.spark, self.folder).join(F.broadcast(hit), F.col("target_id") == F.col("node_id"))  # at most k entities
        g = uses.groupBy("node_id", "label", "c").agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
        return g.select(F.lit("graph").alias("route"), F.col("node_id").alias("id"), (F.col("c") * 10).alias("score"), F.concat_ws(" ", "label", F.lit("<-"), "first", F.concat(F.lit("and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).alias("snippet"))

    def routes(self, p: Plan) -> tuple[str, ...]:
        """The plan's routes in this mode: raw text is searched by keywords, vectors or both."""
        text = {"lexical": ("raw",), "dense": ("dense",), "hybrid": ("raw", "dense") if self.indexes else ("raw",)}[self.mode]
        return tuple(dict.fromkeys(x for r in p.routes for x in (text if r == "raw" else (r,))))

    def gather(self, query: str, routes: tuple[str, ...] | None = None) -> tuple[DataFrame, list[dict]]:
        """Hits of all routes and what became of each. Every route is run here, at most k rows of it are taken, and one that fails, at whatever point, leaves the others.

        In dense mode vectors that don't fit are an error, as nothing else could answer.
        """
        p = self.plan(query)
        hits, notes = [], []
        for r in routes or self.routes(p):
            began = time.perf_counter()
            try:
                got = getattr(self, f"_{r}")(p).select("route", "id", F.col("score").cast("double").alias("score"), "snippet").collect()  # at most k rows
                hits += [tuple(x) for x in got]
                notes.append({"route": r, "status": "ok", "hits": len(got), "seconds": round(time.perf_counter() - began, 3)})
            except Exception as e:  # noqa: BLE001
                if self.mode == "dense" and r == "dense":
                    raise
                notes.append({"route": r, "status": "skipped", "why": str(e).split("\n")[0][:200]})
        return self.spark.createDataFrame(hits, HIT), notes

    def search(self, query: str, k: int | None = None, routes: tuple[str, ...] | None = None) -> DataFrame:
        """(rank, route, id, score, snippet): routes fused by weighted reciprocal ranks, equal ones by route and id."""
        return self._fused(self.gather(query, routes)[0], k)

    def _fused(self, hits: DataFrame, k: int | None = None) -> DataFrame:
        w = F.coalesce(*(F.when(F.col("route") == r, F.lit(x)) for r, x in self.weights.items()), F.lit(1.0))
        ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("score"), "id")))  # k rows a route
        fused = ranked.withColumn("score", w / (60 + F.col("r"))).orderBy(F.desc("score"), "route", "id").limit(k or self.k)
        return fused.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "route", "id")).alias("rank"), "route", "id", "score", "snippet")

    def context(self, query: str, most: int = 4000) -> DataFrame:
        """(route, id, block): evidence blocks in the order of rank that fit ``most`` characters, up to the first that doesn't."""
        return self._context(self.search(query), most)

    def _context(self, found: DataFrame, most: int) -> DataFrame:
        s = found.withColumn("block", F.concat(F.lit("["), F.col("route"), F.lit(" "), F.col("id"), F.lit("] "), F.col("snippet")))
        used = F.sum(F.length("block") + 2).over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        return s.withColumn("used", used).where(F.col("used") - 2 <= most).select("rank", "route", "id", "block")

    def ask(self, query: str, most: int = 4000) -> dict:
        """Plan, rewritten query, evidence blocks, a draft from them and what became of each route; without any hit the draft says so."""
        p = self.plan(query)
        hits, notes = self.gather(query)
        blocks = [r.asDict() for r in self._context(self._fused(hits), most).orderBy("rank").collect()]  # within ``most`` characters
        draft = [f"{p.intent}: {p.query}", *(f"{i}. {b['block']}" for i, b in enumerate(blocks[:6], 1))] if blocks else [f"{p.intent}: {p.query}", "No evidence was found."]
        return {"plan": p, "rewritten": self.rewrite(p), "evidence": blocks, "draft": "\n".join(draft), "routes": notes}
