from lodeline.engine import Engine
from lodeline.operators import embedding


def test_plan(spark, sf_dir):
    e = Engine(spark, sf_dir)
    assert e.plan("Influence of grain size on flotation").intent == "influence"
    p = e.plan("nickel nickel matte?")
    assert p.intent == "search" and p.terms == ["nickel", "matte"] and len(p.variants) <= 8


def test_search_and_context(spark, sf_dir):
    e = Engine(spark, sf_dir, k=5)
    hits = e.search("flotation of fine grains in the ball mill").collect()
    assert 0 < len(hits) <= 5 and [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert len(e.context("flotation of fine grains", 300).collect()) < 5


def test_missing_tables_are_noted(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    hits, notes = e.gather("nickel")
    assert hits.count() == 0 and {n["status"] for n in notes} == {"skipped"}


def test_provider_errors_are_rows(spark):
    def make():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[1.0, 2.0] for _ in texts]

        return call

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, t string")
    got = {r["id"]: (r["embedding"], r["error"]) for r in embedding.provided(df, "id", "t", make).collect()}
    assert got[1] == ([1.0, 2.0], None) and got[2][0] is None and "no" in got[2][1] and got[3][0] == [1.0, 2.0]


def test_hash_vectors(spark):
    """By hand: blake2b-64 read as a little-endian number, its remainder is the place, its top bit means minus."""
    import hashlib
    import math

    def by_hand(text, dim):
        v = [0.0] * dim
        for w in text.split():
            for x, weight in [(w, 1.0), *(((w[i : i + 3], 0.35) for i in range(len(w) - 2)) if len(w) >= 5 else ())]:
                d = hashlib.blake2b(x.encode(), digest_size=8).digest()
                n = sum(byte << (8 * i) for i, byte in enumerate(d))
                v[n % dim] += (-1 if d[7] >= 128 else 1) * weight * math.log1p(len(x))
        return [x / math.hypot(*v) for x in v]

    df = spark.createDataFrame([(1, "nickel ore nickel", "q"), (2, "", "q"), (3, None, "q")], "i int, t string, embedding string")
    got = {r["i"]: r["embedding"] for r in embedding.hashed(df, "i", "t", 64).collect()}
    assert max(abs(a - b) for a, b in zip(got[1], by_hand("nickel ore nickel", 64))) < 1e-12
    assert got[2] == got[3] == [0.0] * 64


def test_indexes_modes_and_reasons(spark, sf_dir, tmp_path):
    import pytest

    from lodeline.operators import index

    e = Engine(spark, sf_dir, k=5, indexes=str(tmp_path / "i"), dimension=64)
    query = 'effect of "grain size" on nickel flotation in 2010'
    _, notes = e.gather(query, ("raw", "dense"))
    assert [n["status"] for n in notes] == ["skipped", "skipped"]  # nothing is built yet, the others would still answer
    built = e.build()
    assert built["vectors"].dimension == 64 and built["lexical"].count == built["vectors"].count > 0
    got = e.ask(query)
    assert {n["route"]: n["status"] for n in got["routes"]} == {"raw": "ok", "dense": "ok", "summaries": "ok"}
    assert got["plan"].phrases == ["grain size"] and got["plan"].years == ["2010"] and "nickel" in got["plan"].concepts and got["evidence"] and got["rewritten"].startswith('"grain size"')
    plain = Engine(spark, sf_dir, k=5)._raw(e.plan(query)).collect()
    stored = e._raw(e.plan(query)).collect()
    assert sorted((r["id"], round(r["score"], 9)) for r in plain) == sorted((r["id"], round(r["score"], 9)) for r in stored)
    wrong = Engine(spark, sf_dir, indexes=str(tmp_path / "i"), dimension=128, mode="dense")
    with pytest.raises(index.Unfit):
        wrong.search(query)
    assert Engine(spark, sf_dir, mode="lexical").search("nickel graph", routes=("graph", "tables")).count() >= 0


def test_nearest_by_scan_and_by_blocks(spark):
    from lodeline.operators import search as S

    rows = [(i, [float((i * k) % 7) for k in (1, 2, 3)], "q") for i in range(60)] + [(99, None, "q"), (98, [1.0], "q")]
    df = spark.createDataFrame(rows, "i bigint, v array<float>, row_id string")
    ask = df.where("i % 10 = 0")
    one = sorted(tuple(r) for r in S.nearest(df, ask, "i", "v", 3).collect())
    two = sorted(tuple(r) for r in S.nearest(df, ask, "i", "v", 3, most_numbers=9).collect())
    assert one == two and len(one) == 18
    assert S.nearest(df.limit(0), ask, "i", "v", 3).count() == 0 and S.nearest(df, ask.limit(0), "i", "v", 3).count() == 0
