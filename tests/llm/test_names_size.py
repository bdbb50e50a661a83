import pyarrow as pa

from lodeline.llm import names as N


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Keys made in Python are many times the rows that Spark takes them for, so no join may send them to the driver."""
    plans, stored = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df, label="t": (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    rows = [("a1", "Ivan Zevobumchuk", ["Water Laboratory of Trasiminsk"]), ("a2", "Zevobumchuk, I.", ["Water Laboratory of Trasiminks"]), ("a3", "Zevobumhcuk, I.", None)]
    df = spark.createDataFrame([(i, n, None, a, None, None, "author") for i, n, a in rows], "author_id string, raw_name string, normalized_name string, affiliations array<string>, email string, orcid string, role string")
    assert {r["id"] for r in N.entities(df).collect()} == {"a1", "a2", "a3"}
    joins = [p for p in plans if "_probe" in p]
    assert len(joins) == 3 and not any("Broadcast" in p for p in joins)


def test_keys_come_in_small_batches():
    word = [f"plidasistov{k:04d}" for k in range(2000)]
    batch = pa.record_batch([["x"] * 2000, word, [1] * 2000], ["grp", "name", "n"])
    got = list(N._probe(iter([batch])))
    assert sum(b.num_rows for b in got) == sum(len(N.probe_keys(w)) for w in word) and max(b.num_rows for b in got) <= 16_384
