"""Keyword, vector and hybrid search.

All functions are plans over whole tables. Null and empty texts have no postings and are never found; ties are
settled by the id; k <= 0 gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.runtime import col, spread

K1, B = 1.2, 0.75
QUERY_NUMBERS = 4_000_000  # numbers of the queries that go to every task, and of one block of a matrix product


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, term, tf)."""
    terms = df.select(col(id_col).alias("row_id"), F.explode(T.words(col(text_col))).alias("term"))
    return terms.groupBy("row_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def query_terms(spark: SparkSession, query: str, most: int = 16) -> list[str]:
    """Distinct words of a query in its order."""
    return spark.range(1).select(F.slice(F.array_distinct(T.words(F.lit(query))), 1, most).alias("t")).first()["t"]


def idf(docs: float, df: float) -> float:
    """Weight of a word in ``df`` of ``docs`` texts; one in more than half of them keeps a trace."""
    x = math.log((docs - df + 0.5) / (df + 0.5))
    return x if x > 0 else 1e-6


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, k: int, most_terms: int = 16) -> DataFrame:
    """(row_id, score) of the best k rows without an index: words are counted within each row, so nothing but the figures of the corpus and the best rows is moved.

    ``operators.index`` answers the same from stored postings.
    """
    terms = query_terms(df.sparkSession, query, most_terms)
    if not terms or k <= 0:
        return df.select(col(id_col).alias("row_id"), F.lit(0.0).alias("score")).limit(0)
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
    words = T.once(T.words(col(text_col)), lambda w: F.struct(F.size(w).alias("n"), spaced(w).alias("s")))
    counted = df.where(col(text_col).isNotNull()).select(col(id_col).alias("row_id"), words.alias("w")).where("w.n > 0")
    tf = counted.select("row_id", F.col("w.n").alias("n"), *(((F.length("w.s") - F.length(F.replace("w.s", F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).alias(f"t{i}") for i, t in enumerate(terms)))
    f = tf.agg(F.count("*").cast("double").alias("docs"), F.avg(F.col("n").cast("double")).alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    part = [F.when(F.col(f"t{i}") > 0, F.lit(idf(f["docs"], f[f"d{i}"])) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("n") / F.lit(f["mean"] or 1.0)))).otherwise(0.0) for i in range(len(terms))]
    some = tf.where(sum((F.col(f"t{i}") for i in range(len(terms))), F.lit(0.0)) > 0)
    return some.select("row_id", sum(part, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "row_id").limit(k)


def unit(vector: str) -> F.Column:
    """A vector scaled to length 1; zero vectors stay."""
    n = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(F.col(vector), lambda x: x.cast("double") / n)).otherwise(F.transform(F.col(vector), lambda x: x.cast("double")))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, most_numbers: int = QUERY_NUMBERS) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of highest dot product for each query, exactly.

    Queries of up to ``most_numbers`` numbers in all go to every task as one matrix, and the rows are scanned
    once where they lie; more are hashed into blocks of that size, and each is joined with blocks of rows. In
    both cases a product of matrices keeps its best k for each query and a window merges those; no pair of single
    rows is ever a row of a plan. Vectors of another length than the queries' are left out.
    """
    base = vectors.select(col(id_col).alias("row_id"), col(vector_col).alias("v")).where("v is not null")
    ask = queries.select(col(id_col).alias("query_id"), col(vector_col).alias("v")).where("v is not null")
    kinds = base.schema["row_id"].dataType.simpleString(), ask.schema["query_id"].dataType.simpleString()
    sizes = ask.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = sizes["dim"] or 0
    base, ask = base.where(F.size("v") == dim), ask.where(F.size("v") == dim)
    out = f"query_id {kinds[1]}, row_id {kinds[0]}, score double"
    if not sizes["n"] or not dim:
        return base.sparkSession.createDataFrame([], f"{out}, rank int")
    if sizes["n"] * dim <= most_numbers:
        asked = ask.toArrow()  # at most ``most_numbers`` numbers
        ids, matrix = asked["query_id"].combine_chunks(), _matrix(asked["v"].combine_chunks(), dim)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), k)
            for b in batches:
                best.add(matrix @ _matrix(b["v"], dim).T, b["row_id"])
            yield from best.rows(ids)

        part = spread(base).mapInArrow(scan, out)
    else:

        def blocks(df: DataFrame, key: str, n: int) -> DataFrame:
            return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{key}_b")).agg(F.collect_list(key).alias(key), F.flatten(F.collect_list("v")).alias(f"{key}_v"), F.count("*").alias(f"{key}_n"))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    rows, asks = b["row_id"][r].values, b["query_id"][r].values
                    best = _Best(len(asks), k)
                    m, q = (b[c][r].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in ("row_id_v", "query_id_v"))
                    best.add(q @ m.T, rows)
                    yield from best.rows(asks)

        of = lambda n: max(1, -(-n * dim // most_numbers))
        grid = blocks(base, "row_id", of(base.count())).crossJoin(blocks(ask, "query_id", of(sizes["n"])))  # pairs of blocks
        part = grid.select("row_id", "row_id_v", "query_id", "query_id_v").mapInArrow(product, out)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))).where(F.col("rank") <= k)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists of one length as rows, without going through Python numbers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Best:
    """Best k rows of every query so far; of equal scores the lower id stays."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, np.full((queries, 0), -np.inf), None

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        if not len(ids) or not score.size:
            return
        new = np.broadcast_to(ids.to_numpy(zero_copy_only=False), score.shape)
        self.score = np.concatenate([self.score, score], axis=1)
        self.ids = new if self.ids is None else np.concatenate([self.ids, new], axis=1)
        order = np.lexsort((self.ids, -self.score), axis=1)[:, : self.k]
        self.score, self.ids = np.take_along_axis(self.score, order, axis=1), np.take_along_axis(self.ids, order, axis=1)
        self.kind = ids.type

    def rows(self, queries: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            n = self.score.shape[1]
            yield pa.record_batch([queries.take(pa.array(np.repeat(np.arange(len(queries)), n))), pa.array(self.ids.ravel().tolist(), self.kind), pa.array(self.score.ravel())], ["query_id", "row_id", "score"])


def nearest_one(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(row_id, score) for one query vector, in the JVM; the partial best k of every partition are merged."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(col(vector_col), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(col(id_col).alias("row_id"), dot.alias("score")).orderBy(F.desc("score"), "row_id").limit(max(0, k))


def rank_fusion(streams: list[DataFrame], k: int, depth: int = 50, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(row_id, score, streams): reciprocal-rank fusion of ranked lists (row_id, score) of at most ``depth`` rows each."""
    weights = weights or [1.0] * len(streams)
    parts = []
    for s, w in zip(streams, weights):
        top = s.orderBy(F.desc("score"), "row_id").limit(depth)  # bounded, so one window over it is small
        ranked = top.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "row_id")))
        parts.append(ranked.select("row_id", (F.lit(w) / (constant + F.col("r"))).alias("c")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("row_id").agg(F.sum("c").alias("score"), F.count("*").alias("streams")).orderBy(F.desc("score"), "row_id").limit(k)


def table_rows(df: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """(table_id, row_no from 1, row): lines of a table's text; the first is its header."""
    lines = df.select(col(id_col).alias("table_id"), F.posexplode(F.split(col(text_col), "\n")).alias("p", "row")).where(F.trim("row") != "")
    out = lines.select("table_id", (F.col("p") + 1).alias("row_no"), "row")
    return out.where(F.col("row_no") <= most) if most else out


def separator(line: F.Column) -> F.Column:
    """The first of tab, bar, semicolon and comma that a header holds; else white space."""
    return F.when(line.contains("\t"), "\t").when(line.contains("|"), "|").when(line.contains(";"), ";").when(line.contains(","), ",").otherwise(" ")


def phrase(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(row_id, hits): texts that hold the query's words one after the other, and how often.

    The words of a text are joined by single spaces with borders, so that a phrase is one containment test.
    """
    words = df.sparkSession.range(1).select(T.words(F.lit(query)).alias("w")).first()["w"]
    if not words:
        return df.select(col(id_col).alias("row_id"), F.lit(0).cast("bigint").alias("hits")).limit(0)
    mark = " " + "  ".join(words) + " "
    hits = T.once(F.concat(F.lit(" "), F.array_join(T.words(col(text_col)), "  "), F.lit(" ")), lambda t: ((F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)).cast("bigint"))
    return df.select(col(id_col).alias("row_id"), hits.alias("hits")).where("hits > 0")
