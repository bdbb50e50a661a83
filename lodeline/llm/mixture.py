"""Mixing sources to target shares of the tokens.

Method: weighted fair queueing. Every use of a document gets a virtual finish time, its source's running
tokens in shuffled order divided by the source's weight. In the order of these times the sources advance in
proportion to their weights; the mixture is that order, cut at the token budget. Running sums go over buckets
of bounded size, so no source and no order is ever in one task.

The default budget is the largest with which every source that has documents can meet its share within its
repeats; with a larger one the scarce sources run out and the reported shares say so.

Edge cases (tests/llm/test_packing.py): null and empty texts have no tokens and are never used; sources without
targets, targets without documents or weight contribute nothing, and the other weights are scaled up; repeated
rows are documents of their own; empty tables give an empty result; extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from lodeline.operators.prefix import running_sum, running_sums
from lodeline.runtime import stored

BUCKET_ROWS = 20_000  # rows of one bucket of a running sum, on average


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[list[dict], int]:
    """Per listed source: weight, tokens at hand, repeats needed; and the budget. One row for each listed source reaches the driver."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in goal.join(have, "source", "left").orderBy("source").collect()]
    live = [r for r in rows if (r["tokens"] or 0) > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    scale = sum(r["target_share"] for r in live)
    for r in rows:
        r["weight"] = r["target_share"] / scale if r in live else 0.0
    if budget is None:
        budget = int(min((r["tokens"] * r["max_repeats"] / r["weight"] for r in live), default=0))
    for r in rows:
        r["repeats"] = min(r["max_repeats"], int(-(-budget * r["weight"] // r["tokens"]))) if r in live else 0
    return rows, budget


def mix(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, seed: int = 11, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (position, id, source, use, n_tokens, finish, running_tokens) and its report by listed source."""
    spark = df.sparkSession
    sizes = stored(count_tokens(df, text_col, {"id": id_col, "source": source_col}, folder, vocabulary).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows, budget = plan(sizes, targets, budget)
    n = max([r["documents"] or 0 for r in rows], default=0)
    bits = (n // BUCKET_ROWS).bit_length()
    table = spark.createDataFrame([(r["source"], float(r["weight"]), int(r["repeats"])) for r in rows if r["repeats"]], "source string, weight double, repeats int")
    uses = sizes.join(F.broadcast(table), "source").withColumn("use", F.explode(F.sequence(F.lit(1), "repeats")))  # a row for each listed source
    shuffled = uses.withColumn("key", F.xxhash64("row", "use", F.lit(seed)))
    top = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)
    shuffled = shuffled.withColumn("bucket", F.shiftleft(F.col("use").cast("bigint"), bits) + top)  # by use, then by the key's first bits
    queued = running_sum(shuffled, ["source"], "bucket", [F.col("key"), F.col("row")], "n_tokens", "sent").withColumn("finish", F.col("sent") / F.col("weight"))
    queued = stored(queued.select("id", "row", "source", "use", "n_tokens", "finish"), "queued")
    count = queued.agg(F.count("*").alias("n"), F.max("finish").alias("last")).first()
    steps = max(1, (count["n"] or 0) // BUCKET_ROWS + 1)
    span = float(count["last"] or 1.0)
    timed = queued.withColumn("bucket", F.least(F.floor(F.col("finish") / span * steps), F.lit(steps)).cast("bigint")).withColumn("one", F.lit(1).cast("bigint"))
    order = [F.col("finish"), F.col("source"), F.col("use"), F.col("row")]
    ranked = running_sums(timed.withColumn("all", F.lit(0)), ["all"], "bucket", order, {"running_tokens": "n_tokens", "position": "one"}).where(F.col("running_tokens") <= budget)
    mixture = stored(ranked.select("position", "id", "source", "use", "n_tokens", "finish", "running_tokens"), "mixture")
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("use").alias("most_uses"))
    wanted = spark.createDataFrame([(r["source"], r["target_share"], float(r["weight"]), r["max_repeats"]) for r in rows], "source string, target_share double, reachable_share double, max_repeats int")
    report = (
        wanted.join(used, "source", "left").fillna(0, ["tokens", "uses", "most_uses"])
        .withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row for each listed source
        .withColumn("actual_share", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0)).drop("all")
    )
    return mixture.withColumnRenamed("id", id_col), report
