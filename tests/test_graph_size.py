from pyspark.sql import functions as F

from lodeline.operators import graph as G


def test_only_paths_that_can_go_on_are_carried(spark, monkeypatch):
    """The paths through a hub to its leaves aren't stored and joined again; the result has them all the same."""
    kept, stored = {}, G.stored
    monkeypatch.setattr(G, "stored", lambda df, label="t": kept.setdefault(label, []).append(x := stored(df, label)) or x)
    edges = spark.createDataFrame([(f"c{i}", "n", "in") for i in range(50)] + [("n", "r", "of")], "source_id string, target_id string, type string")
    got = G.paths(edges, edges.select(F.col("source_id").alias("node_id")).where("node_id like 'c%'"), 3).collect()
    assert len(got) == len({r["label"] for r in got}) == 50 + 50 * 50 and "c0 -[in]-> n -[reverse:in]-> c1" in {r["label"] for r in got}
    assert sum(x.count() for x in kept["front"]) == 50
