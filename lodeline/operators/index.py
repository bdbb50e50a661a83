"""Stored indexes: postings for keyword search, vectors for nearest rows, and a manifest that says what they hold.

An index is a folder of Parquet tables. Rows without an id or a text are not indexed; building twice replaces the
index; a folder without a manifest, or with one of another kind, dimension or model, is refused with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import embedding
from lodeline.operators import search as S
from lodeline.runtime import col, spread
from lodeline.sources.files import exists

BUCKETS = 64  # folders of the postings; a query reads those of its terms only


class Unfit(ValueError):
    """Why an index can't answer."""


@dataclass(frozen=True)
class Manifest:
    kind: str
    model: str
    dimension: int
    count: int
    digest: int

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.kind, self.model, self.dimension, self.count, self.digest)], "kind string, model string, dimension int, count bigint, digest bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @staticmethod
    def read(spark: SparkSession, path: str, kind: str, model: str | None = None, dimension: int | None = None) -> Manifest:
        """The manifest at ``path``; an index that is missing, of another kind, model or dimension, or empty is :class:`Unfit`."""
        if not exists(spark, f"{path}/manifest"):
            raise Unfit(f"no index at {path}")
        m = Manifest(**spark.read.parquet(f"{path}/manifest").first().asDict())
        for name, want, got in (("kind", kind, m.kind), ("model", model, m.model), ("dimension", dimension, m.dimension)):
            if want is not None and want != got:
                raise Unfit(f"{name} is {got}, not {want}")
        if not m.count:
            raise Unfit("the index is empty")
        return m


def _indexable(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(col(id_col).alias("row_id"), col(text_col).alias("text")).where("row_id is not null and trim(text) <> ''")


def _digest(df: DataFrame) -> tuple[int, int]:
    """(rows, digest of ids and texts); the digest doesn't depend on the order of rows."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row_id", "text")).alias("d")).first()
    return r["n"], r["d"] or 0


def build_lexical(df: DataFrame, id_col: str, text_col: str, path: str, buckets: int = BUCKETS) -> Manifest:
    """Write postings (term, row_id, tf, n) by bucket of their term, sorted by term, n being the text's number of words; and the corpus' figures."""
    spark = df.sparkSession
    base = _indexable(df, id_col, text_col)
    words = base.select("row_id", T.words(F.col("text")).alias("w")).select("row_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    posts = words.groupBy("row_id", "n", "term").agg(F.count("*").alias("tf")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    posts.repartition(buckets, "bucket", F.pmod(F.xxhash64("row_id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    base.select(F.size(T.words(F.col("text"))).cast("double").alias("n")).where("n > 0").agg(F.count("*").cast("double").alias("docs"), F.avg("n").alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/figures")
    n, d = _digest(base)
    m = Manifest("lexical", "words", 0, n, d)
    m.write(spark, path)
    return m


def bm25(spark: SparkSession, path: str, query: str, k: int, most_terms: int = 16) -> DataFrame:
    """(row_id, score) of the best k rows by the stored postings: only the folders and row groups of the query's terms are read."""
    Manifest.read(spark, path, "lexical")
    figures = spark.read.parquet(f"{path}/figures").first()
    terms = S.query_terms(spark, query, most_terms)
    posts = spark.read.parquet(f"{path}/postings")
    if not terms or k <= 0:
        return posts.select("row_id", F.lit(0.0).alias("score")).limit(0)
    of = spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in terms))).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(figures["buckets"])).alias("b")).distinct().collect()
    hit = posts.where(F.col("bucket").isin([r["b"] for r in of]) & F.col("term").isin(terms))
    df = {r["term"]: r["d"] for r in hit.groupBy("term").agg(F.count("*").alias("d")).collect()}  # a row for each term of the query
    weight = F.create_map(*(F.lit(x) for t, d in df.items() for x in (t, S.idf(figures["docs"], d)))) if df else F.create_map(F.lit(""), F.lit(0.0))
    f = F.col("tf").cast("double")
    part = weight[F.col("term")] * f * (S.K1 + 1) / (f + S.K1 * (1 - S.B + S.B * F.col("n") / F.lit(figures["mean"])))
    order = {t: i for i, t in enumerate(terms)}  # parts are added in the order of the query, so that equal rows have equal scores
    place = F.create_map(*(F.lit(x) for t, i in order.items() for x in (t, i)))
    summed = hit.select("row_id", F.struct(place[F.col("term")].alias("i"), part.alias("p")).alias("s")).groupBy("row_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most a part for each term
    best = summed.select("row_id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["p"]).alias("score"))
    return best.orderBy(F.desc("score"), "row_id").limit(k)


def build_vectors(df: DataFrame, id_col: str, text_col: str, path: str, dimension: int = 384) -> Manifest:
    """Write hashed embeddings (row_id, embedding) of all texts."""
    base = _indexable(df, id_col, text_col)
    embedding.hashed(spread(base), "row_id", "text", dimension).write.mode("overwrite").parquet(f"{path}/vectors")
    n, d = _digest(base)
    m = Manifest("vectors", "hash", dimension, n, d)
    m.write(df.sparkSession, path)
    return m


def nearest(spark: SparkSession, path: str, query: str, k: int, dimension: int | None = None) -> DataFrame:
    """(row_id, score) of the k rows nearest to the query's own embedding."""
    m = Manifest.read(spark, path, "vectors", "hash", dimension)
    v = embedding.hash_vectors([query], m.dimension)[0].tolist()
    return S.nearest_one(spark.read.parquet(f"{path}/vectors"), "row_id", "embedding", v, k)
