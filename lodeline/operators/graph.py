"""Property graphs in two tables: nodes (node_id, type, label) and edges (edge_id, source_id, target_id, type).

Null ends and self loops make no edge; edges of one id are one edge, the last written wins; a path never visits a
node twice, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.runtime import stored


def node_id(kind: str | Column, label: Column) -> Column:
    """Type and the first 16 hex digits of the normalised label's SHA-1."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit("_"), F.substring(F.sha1(T.normalise(label)), 1, 16))


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("edge_"), F.substring(F.sha1(F.concat_ws("|", source, kind, target)), 1, 20))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node: the first label, and how often it was seen; ``nodes`` has (node_id, type, label, seq)."""
    return nodes.where("label is not null").groupBy("node_id", "type").agg(F.min_by("label", F.struct("seq", "label")).alias("label"), F.count("*").alias("mentions"))


def merge_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per edge id, without null ends, loops and, where ``nodes`` is given, unknown ends."""
    e = edges.where("source_id is not null and target_id is not null and source_id <> target_id")
    e = e.withColumn("edge_id", edge_id(F.col("source_id"), F.col("type"), F.col("target_id")))
    e = e.groupBy("edge_id").agg(*(F.max_by(c, "seq").alias(c) for c in ("source_id", "target_id", "type")), F.count("*").alias("mentions"))
    if nodes is not None:
        ids = nodes.select("node_id")
        e = e.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return e


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, type): every edge and its reverse, named ``reverse:type``."""
    f = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "type")
    return f.unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.concat(F.lit("reverse:"), "type").alias("type")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("degree"), F.count_distinct("b").alias("neighbours"))


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node_id, type, other) of the nodes in ``start``."""
    return start.select("node_id").join(both_ways(edges), F.col("node_id") == F.col("a")).select("node_id", "type", F.col("b").alias("other"))


SALTS = 32  # parts of a node's edges in a walk


def paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start_id, end_id, path, types, label, depth) of all simple paths of up to ``depth`` edges from the nodes in ``start``; ``label`` is the path as :func:`render` writes it.

    A path that has come to a node with one neighbour can't go on, so only the others are carried to the next step:
    the paths through a hub, which are most, are made once and by the last join. Hubs are spread: their edges lie in
    SALTS parts, each of which meets a copy of the paths that end there.
    """
    step = both_ways(edges)
    inner = stored(step.groupBy("a").agg((F.min("b") < F.max("b")).alias("on")).where("on").select("a"), "inner")
    step = step.withColumn("part", F.pmod(F.xxhash64("b", "type"), F.lit(SALTS)).cast("int"))
    step = stored(step.join(inner.select(F.col("a").alias("b"), F.lit(True).alias("on")), "b", "left").select("a", "b", "type", "part", F.coalesce("on", F.lit(False)).alias("on")), "edges")  # every step joins the same table
    front = start.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("end_id"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("types"), F.col("node_id").alias("label"))
    out = None

    def walked(front: DataFrame, step: DataFrame) -> DataFrame:
        copies = front.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return (
            copies.join(step.hint("shuffle_hash"), (F.col("end_id") == F.col("a")) & (F.col("salt") == F.col("part"))).where(~F.array_contains("path", F.col("b")))
            .select("start_id", F.col("b").alias("end_id"), F.concat("path", F.array("b")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.concat("label", F.lit(" -["), "type", F.lit("]-> "), "b").alias("label"))
        )

    for k in range(1, depth + 1):
        here = walked(front, step).withColumn("depth", F.lit(k))
        out = here if out is None else out.unionByName(here)
        if k < depth:
            front = stored(walked(front, step.where("on")), "front")
    return out


def render(path: Column, types: Column) -> Column:
    """``a -[t]-> b -[u]-> c``."""
    return F.aggregate(F.arrays_zip(types.alias("t"), F.slice(path, F.lit(2), F.size(types)).alias("n")), F.element_at(path, 1), lambda acc, x: F.concat(acc, F.lit(" -["), x["t"], F.lit("]-> "), x["n"]))
