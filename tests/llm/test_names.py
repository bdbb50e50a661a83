import random

import pytest
from pyspark.sql import functions as F

from lodeline.llm import names as N

SCHEMA = "author_id string, raw_name string, normalized_name string, affiliations array<string>, email string, orcid string, role string, place string, id int"


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Plidasistov, Sergey Petrovich", ("plidasistov", "sergey", "petrovich")),
        ("VebukestovMF", ("vebukestov", "m", "f")),
        ("к.т.н. Бранорунко Е. А.", ("branorunko", "e", "a")),
        ("Dr. I. Krosedolmann", ("krosedolman", "i", "")),
        ("SHALELERBACH, Ted", ("shalelerbach", "edward", "")),
        ("Friedrich Grikobupsky", ("grikobupski", "friedrich", "")),
        ("Вoдубoстoв Анна", ("vodubostov", "anna", "")),
        (None, None),
        ("", None),
    ],
)
def test_person(name, want):
    assert N.person(name) == want


def test_organisation():
    same = ["The Water Laboratory of Trasiminsk", "Лаб. воды, Трасиминск", "TRASIMINSK WATER LABORATORY", "Лаборатория воды, г. Трасиминск"]
    assert {N.organisation(x) for x in same} == {("trasiminsk", "water")}
    assert N.organisation("") is None


def test_segment_join_misses_nothing():
    """Any two names within the slips that their lengths allow share a key, one swap of neighbours included."""
    r = random.Random(3)
    met = 0
    for _ in range(20_000):
        a = "".join(r.choice("abcd") for _ in range(r.randint(4, 12)))
        b = list(a)
        swaps = 0
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(b))
            if r.random() < 0.3 and not swaps and k + 1 < len(b):
                b[k], b[k + 1] = b[k + 1], b[k]
                swaps = 1
            elif b:
                b[k : k + 1] = r.choice([[], [r.choice("abcd")], [b[k], r.choice("abcd")]])
        b = "".join(b) or "a"
        most = N.slips(min(len(a), len(b)))
        if most and N.distance(a, b, most) <= most:
            met += 1
            assert N.index_keys(a) & N.probe_keys(b), (a, b)
    assert met > 5000


def test_distance():
    assert N.distance("abcd", "abdc", 2) == 1 and N.distance("abc", "abc", 0) == 0 and N.distance("abc", "xyz", 2) == 3


def test_entities(spark):
    w = ["Water Laboratory, Trasiminsk"]
    rows = [
        ("a1", "Sergey Petrovich Plidasistov", None, w, None, None, "author", "x", 1),
        ("a1", "Sergey Petrovich Plidasistov", None, w, None, None, "author", "x", 1),
        ("a2", "Plidasistov S. P.", None, ["Лаб. воды, Трасиминск"], None, None, "author", None, 1),
        ("a3", "Plidasitsov, Sergey", None, ["The Water Laboratory of Trasiminks"], None, None, "author", None, 1),
        ("a4", "Sergey Petrovich Plidasistov", None, ["Technical University, Domuduvka"], None, None, "author", None, 1),  # a namesake
        ("a5", "Plidasistov Olga", None, w, None, None, "author", None, 1),  # a relative
        ("a6", None, None, None, None, None, "author", None, 1),
        ("a7", "", "", [], "", "", None, None, 1),
        ("o1", "Water Laboratory, Trasiminsk", None, None, None, None, "organization", None, 1),
        ("o2", "ФГУП Лаборатория воды Трасиминск", None, None, None, None, "organization", None, 1),
        (None, "x y", None, None, None, None, None, None, 1),
    ]
    got = {(r["author_id_a"], r["author_id_b"]) for r in N.pairs(N.entities(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("o1", "o2")}


def test_empty(spark):
    assert N.pairs(N.entities(spark.createDataFrame([], SCHEMA))).count() == 0


def test_settle_leaves_the_undecided_alone():
    p = [{"kind": "", "given": g, "patronymic": q} for g, q in (("sergey", "petrovich"), ("semyon", "ivanovich"), ("s", ""))]
    assert N.settle(p) == [0, 1, None] or N.settle(p) == [1, 0, None]
    assert F is not None


def test_orcid_joins_entities_and_missing_parts_meet_all(spark):
    """An ORCID joins what spelling can't, a placeholder ORCID nobody; a surname alone meets the one person who has it."""
    rows = [("a1", "Ivan Zevobumchuk", "Water Laboratory of Trasiminsk", "0000-0001"), ("a2", "Zevobumchuk, I.", "Water Laboratory of Pokelanovo", "0000-0001"), ("a3", "Zevobumchuk", None, None)]
    rows += [(f"p{i}", f"Ivan {n}", "Water Laboratory of Trasiminsk", "0000-0000") for i, n in enumerate(("Karpelenko", "Bodurivsky", "Malotirov", "Gredunchak", "Sutovenko"))]
    df = spark.createDataFrame([(i, n, None, [a] if a else None, None, o, "author") for i, n, a, o in rows], "author_id string, raw_name string, normalized_name string, affiliations array<string>, email string, orcid string, role string")
    by = {r["id"]: r["entity"] for r in N.entities(df).collect()}
    assert by["a1"] == by["a2"] and len({by[f"p{i}"] for i in range(5)}) == 5
