import pytest

from lodeline.llm import encoding as E

RU = "Основную роль играет удаление сульфатов на участке номер {}; измерения повторены {} раз при разных условиях"
FR = "La fusion éclair a été étudiée et les mesures ont été répétées {} fois ; la qualité reste élevée à {} %"


def garble(text, written, read):
    return text.encode(written).decode(read, "replace")


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")])
def test_undo(written, read):
    assert E.undo(garble("Основную роль", written, read), written, read) == "Основную роль" or "�" in garble("Основную роль", written, read)


def test_transformations():
    clean = RU.format(1, 2)
    assert ("koi8-r", "cp1251") in E.transformations(garble(clean, "koi8-r", "cp1251"), clean)
    assert E.transformations("abc", "abd") == [] or E.transformations("é", "ü") == []


def corpus():
    rows = []
    for i in range(80):
        rows += [(i * 2, RU.format(i, i + 3), "title"), (i * 2 + 1, FR.format(i, i + 3), None)]
    twins = [(500, garble(RU.format(3, 6), "koi8-r", "cp1251"), "x"), (501, garble(FR.format(3, 6), "utf-8", "latin-1"), "x"), (502, garble(FR.format(4, 7), "utf-8", "latin-1"), "x")]
    lone = [(600, garble("удаление сульфатов при разных условиях", "koi8-r", "cp1251"), None), (601, garble("la qualité étudiée", "utf-8", "latin-1"), None)]
    odd = [(700, None, None), (701, "", None), (702, "plain ASCII what?", None), (703, "la qualit�", None), (704, RU.format(1, 1) * 300, None), (600, lone[0][1], None)]
    return rows + twins + lone + odd


def test_repair(spark):
    df = spark.createDataFrame(corpus(), "result_id bigint, text string, value string")
    got = E.repair(df, "result_id", ("text", "value")).collect()
    by = {}
    for r in got:
        by.setdefault((r["result_id"], r["field_name"]), []).append(r)
    assert {k[0] for k in by} == {500, 501, 502, 600, 601, 703}
    assert by[500, "text"][0]["repaired"] == RU.format(3, 6) and by[501, "text"][0]["repaired"] == FR.format(3, 6)
    assert by[600, "text"][0]["repaired"] == "удаление сульфатов при разных условиях" and len(by[600, "text"]) == 2
    assert by[601, "text"][0]["repaired"] == "la qualité étudiée"
    assert by[703, "text"][0]["recovered"] is False


def test_empty(spark):
    df = spark.createDataFrame([], "result_id bigint, text string, title string")
    assert E.repair(df, "result_id", ("text", "title")).count() == 0


def test_every_variant_meets_a_clean_twin(spark):
    """A clean text with several garbled twins teaches each of their transformations; a pair outside the grid teaches its characters."""
    rows = [(i, RU.format(i, i + 3)) for i in range(60)]
    clean = RU.format(3, 6)
    rows += [(100, garble(clean, "koi8-r", "cp1251")), (101, garble(clean, "cp1251", "cp866")), (102, garble(clean, "cp866", "koi8-r"))]
    df = spark.createDataFrame(rows, "i bigint, text string")
    _, learned, maps = E.learn(df, "i", ("text",))
    assert {("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8-r")} <= set(learned) and not maps
    own = {k: chr(0x2D00 + i) for i, k in enumerate(sorted({ch for ch in RU if ch > "\x7f"}))}  # no encoding does this
    swap = lambda t: "".join(own.get(ch, ch) for ch in t)
    more = [(200 + k, swap(RU.format(k, k + 3))) for k in (5, 6, 7)] + [(300, swap("удаление сульфатов при разных условиях"))]
    df = spark.createDataFrame(rows + more, "i bigint, text string")
    assert len(E.learn(df, "i", ("text",))[2]["own"]) >= E.LEAST_MAP
    got = {r["i"]: r["repaired"] for r in E.repair(df, "i", ("text",)).collect()}
    assert got[300] == "удаление сульфатов при разных условиях"


def test_bigrams_are_bounded():
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    assert len(set(E.bigrams(text))) < 1500 and list(E.bigrams("ёж")) == [" ё", "ёж", "ж "]
