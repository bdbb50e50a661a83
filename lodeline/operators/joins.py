"""Joins beyond the plain ones.

Null keys never match; where sets of tokens are compared an id counts once, with the first of its sets in order; empty
sides give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.prefix import running_sum
from lodeline.runtime import col, stored


def lookup_last(left: DataFrame, right: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """Left join with the last right row of each key; left rows stay as many as they are."""
    last = right.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))
    return left.join(last, key, "left")


def similar_sets(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens_col: str, least: float) -> DataFrame:
    """(left id, right id, shared, jaccard) of all pairs whose token sets reach ``least``, without comparing all pairs.

    Prefix filtering: with tokens ordered from rare to frequent, two sets that reach the threshold share one
    of their first n - ceil(least * n) + 1 tokens. Candidates come from an equi-join on those and are verified.
    """
    one = lambda df, i, n: stored(df.select(col(i).alias(n), F.array_distinct(col(tokens_col)).alias(f"t{n}")).where(F.size(f"t{n}") > 0).groupBy(n).agg(F.min(f"t{n}").alias(f"t{n}")), "sets")
    a, b = one(left, left_id, "a"), one(right, right_id, "b")
    freq = a.select(F.explode("ta").alias("t")).unionByName(b.select(F.explode("tb").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, i: str, t: str) -> DataFrame:
        ranked = df.select(i, F.size(t).alias("m"), F.explode(t).alias("t")).join(freq, "t").withColumn("r", F.row_number().over(Window.partitionBy(i).orderBy("n", "t")))
        return ranked.where(F.col("r") <= F.col("m") - F.ceil(F.lit(least) * F.col("m")) + 1).select(i, F.col("m").alias(f"m_{i}"), "t")

    pa, pb = prefix(a, "a", "ta"), prefix(b, "b", "tb")
    pairs = pa.join(pb, "t").where((F.col("m_a") >= F.lit(least) * F.col("m_b")) & (F.col("m_b") >= F.lit(least) * F.col("m_a"))).select("a", "b").distinct()
    full = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    jac = shared / (F.size("ta") + F.size("tb") - shared)
    return full.select(F.col("a").alias(left_id), F.col("b").alias(right_id), shared.cast("bigint").alias("shared"), jac.alias("jaccard")).where(F.col("jaccard") >= least)


def contained(left: DataFrame, key: str, text: str, terms: str, most: int) -> DataFrame:
    """(key, term, place) of the first ``most`` array items that occur in the row's own text."""
    hit = F.filter(F.transform(col(terms), lambda t, i: F.struct((i + 1).alias("place"), t.alias("term"))), lambda s: col(text).contains(s["term"]))
    return left.select(col(key), F.explode(F.slice(hit, 1, most)).alias("h")).select(col(key), "h.term", "h.place")


def dealt(df: DataFrame, group: str, key: str, n: int, bucket_rows: int = 100_000) -> DataFrame:
    """Rows of each group dealt in turn, in the order of a whole-number key, to ``n`` places (``turn`` from 0)."""
    x = df.withColumn("__bucket", F.floor(col(key) / F.lit(bucket_rows))).withColumn("__one", F.lit(1).cast("bigint"))
    x = running_sum(x, [group], "__bucket", [col(key)], "__one", "turn")
    return x.withColumn("turn", F.pmod(F.col("turn") - 1, F.lit(n))).drop("__bucket", "__one")
