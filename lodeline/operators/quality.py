"""Data-quality checks as issue rows, coverage figures and pass-or-fail gates.

Empty tables give no issues; ratios of empty tables are null and fail their gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col


def issues(df: DataFrame, id_col: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, severity, code) of every rule that a row breaks, in one pass; a rule is (severity, code, condition)."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in rules)))
    return df.select(col(id_col), F.explode(found).alias("i")).select(col(id_col), "i.severity", "i.code")


def tally(found: DataFrame, severities: list[str]) -> DataFrame:
    """Issues of each severity, none left out."""
    every = found.sparkSession.createDataFrame([(s,) for s in severities], "severity string")
    n = found.groupBy("severity").agg(F.count("*").alias("issues"), F.count_distinct("code").alias("codes"))
    return every.join(n, "severity", "left").fillna(0)


def gate(figures: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed) of each condition over a row of figures; an unknown condition fails."""
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))
    return figures.select(F.explode(pairs).alias("c")).select("c.check", "c.passed")
