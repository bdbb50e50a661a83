"""Filling containers of fixed capacity with whole texts while keeping source proportions.

Method: mixture-controlled packing by deficit round-robin. Every placed token adds each source's target share
to its deficit and the placed item is taken from its own source's; the source that lags most gives the next
item, the largest that still fits. Deficits go on from window to window and, over prefix sums of the
partitions' token totals, from partition to partition. The last part of a window takes the item that fills it
best from any source, and the deficits pay that back later.

Edge cases (tests/llm/test_packing.py): null and empty texts need no container; a text over the capacity fills
containers of its own and its rest is packed like any item; null sources are one source; repeated rows are
packed each; an empty table gives an empty result; extra columns can't clash, as only named ones are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from lodeline.runtime import stored

CAPACITY = 2048
SLACK = 1.0  # windows that a source may run ahead of its share to fill the end of one
PART_TOKENS = 4_000_000  # tokens of one packing task


def fill(items: dict[str, list[tuple[int, int]]], shares: dict[str, float], deficits: dict[str, float], capacity: int) -> Iterator[list[tuple[str, int, int]]]:
    """Windows of (source, size, item number); ``items`` holds (size, number) lists in ascending order and is used up."""
    placed = 0  # every placed token adds its share to each source's deficit; kept as one number, not source by source
    while any(items.values()):
        window, room = [], capacity
        while True:
            fitting = [(s, k) for s, q in items.items() if q and (k := bisect_right(q, (room, 1 << 62)) - 1) >= 0]
            if not fitting:
                break
            due = lambda s: deficits[s] + shares[s] * placed  # noqa: B023, E731
            if room > capacity // 4:
                source, k = max(fitting, key=lambda x: (due(x[0]), x[0]))
            else:
                # of the items that fill the rest equally well, the one whose source lags most; a source may run ahead by SLACK windows at most while another fits
                behind = [x for x in fitting if due(x[0]) > -SLACK * capacity] or fitting
                source, k = max(behind, key=lambda x: (items[x[0]][x[1]][0], due(x[0]), x[0]))
            size, number = items[source].pop(k)
            if not items[source]:
                del items[source]
            placed += size
            deficits[source] -= size
            room -= size
            window.append((source, size, number))
        yield window


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, targets: dict[str, float] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(container, slot, id, source, piece, token_start, n_tokens): every text in exactly one place, long ones in pieces.

    ``targets`` are shares by source (default: the shares in ``df``). Items are spread over tasks by hash, so a
    hot source is spread as well; one row a task and source is all that is summed up.
    """
    sizes = count_tokens(df, text_col, {"id": id_col, "source": source_col}, folder, vocabulary).where("n_tokens > 0").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    sizes = stored(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    piece = F.explode(F.sequence(F.lit(0), F.when((F.col("n_tokens") % capacity) == 0, F.greatest(whole - 1, F.lit(0))).otherwise(whole)))
    cut = sizes.select("*", piece.alias("piece")).withColumn("token_start", F.col("piece") * F.lit(capacity).cast("bigint")).withColumn("size", F.least(F.col("n_tokens") - F.col("token_start"), F.lit(capacity)).cast("bigint"))
    total = sizes.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    parts = max(1, round(total / part_tokens))
    placed = cut.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int"))
    by_part = stored(placed.groupBy("part", "source").agg(F.sum("size").alias("n")), "totals")
    if targets is None:
        share = by_part.groupBy("source").agg((F.sum("n") / F.lit(float(total or 1))).alias("share"))
    else:
        share = df.sparkSession.createDataFrame(list(targets.items()) or [("", 0.0)], "source string, share double")
    grid = by_part.select("part").distinct().crossJoin(by_part.select("source").distinct())  # tasks x sources, a grid of sums
    dense = grid.join(by_part, ["part", "source"], "left").join(share, "source", "left").fillna(0)
    tot = dense.withColumn("all", F.sum("n").over(Window.partitionBy("part")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = tot.select("part", "source", "share", (F.coalesce(F.sum("all").over(before), F.lit(0)) * F.col("share") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("deficit"))
    state = start.groupBy("part").agg(F.collect_list(F.struct("source", "share", "deficit")).alias("state"))
    state = state.select(F.col("part"), F.lit("state").alias("kind"), F.to_json("state").alias("state"))
    names = ["part", "kind", "state", "id", "source", "piece", "token_start", "size"]
    kind = placed.schema["id"].dataType
    rows = placed.select("part", F.lit("item").alias("kind"), F.lit(None).cast("string").alias("state"), "id", "source", "piece", "token_start", "size")
    heads = state.select("part", "kind", "state", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("bigint").alias("token_start"), F.lit(None).cast("bigint").alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        head = json.loads(pdf.loc[pdf["kind"] == "state", "state"].iloc[0])
        part = int(pdf["part"].iloc[0])
        pdf = pdf[pdf["kind"] == "item"].sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        shares = {x["source"]: x["share"] for x in head}
        deficits = {x["source"]: x["deficit"] for x in head}
        queues: dict[str, list[tuple[int, int]]] = {}
        for i, (s, n) in enumerate(zip(pdf["source"], pdf["size"])):
            queues.setdefault(s, []).append((int(n), i))
        for q in queues.values():
            q.sort()
        out = [(part * (1 << 32) + w, slot, number) for w, window in enumerate(fill(queues, shares, deficits, capacity)) for slot, (_, _, number) in enumerate(window)]
        got = pd.DataFrame(out, columns=["container", "slot", "number"])
        x = pdf.iloc[got["number"].to_numpy()].reset_index(drop=True)
        return pd.DataFrame({"container": got["container"], "slot": got["slot"], "id": x["id"], "source": x["source"], "piece": x["piece"].astype(int), "token_start": x["token_start"].astype("int64"), "n_tokens": x["size"].astype("int64")})

    every = rows.select(*names).unionByName(heads.select(*names))
    done = every.groupBy("part").applyInPandas(run, f"container bigint, slot int, id {kind.simpleString()}, source string, piece int, token_start bigint, n_tokens bigint")
    return done.withColumnRenamed("id", id_col)


def windows(packed: DataFrame, targets: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(container, tokens, texts, sources, deviation) of packed containers.

    ``deviation`` is the greatest distance, over the sources, between the tokens of the container's task up to its
    end and the share of them that is due, in containers. Shares are those of ``targets`` (source, share) or of all
    containers. A task holds PART_TOKENS tokens, so its running sums are bounded.
    """
    each = packed.groupBy("container", "source").agg(F.sum("n_tokens").alias("n"))
    size = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"), F.count_distinct("source").alias("sources")).withColumn("part", F.shiftright("container", 32))
    if targets is None:
        total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each source
        targets = packed.groupBy("source").agg(F.sum("n_tokens").alias("n")).select("source", (F.col("n") / total).alias("share"))
    upto = Window.partitionBy("part", "source").orderBy("container").rowsBetween(Window.unboundedPreceding, 0)
    filled = size.withColumn("before", F.sum("tokens").over(Window.partitionBy("part").orderBy("container").rowsBetween(Window.unboundedPreceding, 0)))
    grid = filled.select("part", "container", "before").join(F.broadcast(targets))  # a row for each container and source
    run = grid.join(each, ["container", "source"], "left").withColumn("sent", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    worst = run.groupBy("container").agg((F.max(F.abs(F.col("sent") - F.col("share") * F.col("before"))) / capacity).alias("deviation"))
    return size.join(worst, "container").select("container", "tokens", "texts", "sources", "deviation")
