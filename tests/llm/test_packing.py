import random

from lodeline.llm import mixture as M
from lodeline.llm import packing as P

SCHEMA = "doc_id bigint, text string, source string, container string, n_tokens string"


def docs(n=400):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 300), "hot" if i % 3 == 0 else f"s{i % 7}", "q", "q") for i in range(n)]
    return rows + [(9000, None, "s1", "q", "q"), (9001, "", "s1", "q", "q"), (9002, "long " * 5000, None, "q", "q"), rows[0]]


def test_pack(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    got = P.pack(df, part_tokens=20_000).toPandas()
    fill = got.groupby("container").n_tokens.sum()
    assert fill.max() <= 2048 and fill.sum() / len(fill) / 2048 > 0.9
    whole = got[got.doc_id < 9000].groupby("doc_id").size()
    assert whole.drop(0).eq(1).all() and whole[0] == 2  # a repeated row is packed twice, nothing else is split
    long = got[got.doc_id == 9002].sort_values("piece")
    assert list(long.n_tokens[:-1].unique()) == [2048] and (long.token_start == long.piece * 2048).all()
    assert {9000, 9001}.isdisjoint(got.doc_id)


def test_proportions_hold_early():
    items = {s: sorted((50, i) for i in range(n)) for s, n in (("a", 300), ("b", 100))}
    out = [w for _, w in zip(range(3), P.fill(items, {"a": 0.75, "b": 0.25}, {"a": 0.0, "b": 0.0}, 2000))]
    share = sum(n for w in out for s, n, _ in w if s == "a") / sum(n for w in out for _, n, _ in w)
    assert abs(share - 0.75) < 0.02


def test_every_window_keeps_the_proportions(spark):
    """The running shares never leave the targets by more than two windows, and the figure says by how much."""
    r = random.Random(5)
    items = {s: sorted((r.randint(20, 900), i) for i in range(n)) for s, n in (("a", 600), ("b", 200), ("c", 50))}
    total = {s: sum(n for n, _ in q) for s, q in items.items()}
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    sent, placed, worst = dict.fromkeys(items, 0), 0, 0.0
    for window in P.fill(items, shares, dict.fromkeys(shares, 0.0), 2048):
        for s, n, _ in window:
            sent[s] += n
            placed += n
        worst = max(worst, *(abs(sent[s] - shares[s] * placed) / 2048 for s in sent))
    assert worst < 2
    df = spark.createDataFrame(docs(), SCHEMA)
    fill = P.windows(P.pack(df, part_tokens=20_000)).collect()
    assert all(0 <= x["deviation"] < 4 and x["tokens"] <= 2048 for x in fill)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    goal = spark.createDataFrame([("hot", 0.5, 1), ("s1", 0.25, 3), ("s2", 0.15, 2), ("nowhere", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mix(df, goal)
    m, r = mix.toPandas().sort_values("position"), {x["source"]: x for x in report.collect()}
    assert (m.n_tokens.cumsum() == m.running_tokens).all() and list(m.position) == list(range(1, len(m) + 1))
    assert set(m.source) == {"hot", "s1", "s2"} and r["nowhere"]["tokens"] == 0
    for s in ("hot", "s1", "s2"):
        assert abs(r[s]["actual_share"] - r[s]["reachable_share"]) < 0.03 and r[s]["most_uses"] <= r[s]["max_repeats"]
    half = m[m.running_tokens <= m.running_tokens.max() / 2]
    assert abs(half[half.source == "hot"].n_tokens.sum() / half.n_tokens.sum() - 0.5 / 0.9) < 0.08


def test_mix_over_budget_runs_out(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    goal = spark.createDataFrame([("hot", 0.5, 1), ("s1", 0.5, 1)], "source string, target_share double, max_repeats int")
    _, report = M.mix(df, goal, budget=10**9)
    assert all(r["most_uses"] == 1 for r in report.collect())


def test_mix_empty(spark):
    goal = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    mix, report = M.mix(spark.createDataFrame([], SCHEMA), goal)
    assert mix.count() == 0 and report.count() == 0
