import pytest

from lodeline.operators import units

SCHEMA = "procedure_summary_id string, conditions array<string>, process_parameters array<map<string,string>>, unit string, id int"


@pytest.fixture(scope="module")
def scanner():
    return units.Scanner()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("K and Na below 2.82–3,52 g/dm3", [("g/L", 2.82, 3.52, 0.0)]),
        ("2.25·10^5сек", [("s", 225000.0, 225000.0, 0.0)]),
        ("feed 363m³/h, acid 211 215 627 µg/L", [("m3/h", 363.0, 363.0, 0.0), ("ug/L", 211215627.0, 211215627.0, 0.0)]),
        ("101 ± 3.02 deg C", [("degC", 101.0, 101.0, 3.02)]),
        ("stirred for eight minutes", [("min", 8.0, 8.0, 0.0)]),
        ("27897…34871 mm Hg", [("mmHg", 27897.0, 34871.0, 0.0)]),
        ("sample K-7, stage 3 C", []),
        ("pH 1.8, L:S = 4:1, 300 rpm, 25 %", []),
        ("", []),
    ],
)
def test_scan(scanner, text, want):
    assert scanner.scan(text) == want


@pytest.mark.parametrize(("text", "want"), [("1,5", 1.5), ("494 689", 494689.0), ("1,234,567", 1234567.0), ("1.234,5", 1234.5), ("1.2e3", 1200.0), ("none", None)])
def test_number(text, want):
    assert units.number(text) == want


def test_item(scanner):
    assert scanner.item([("name", "time, h"), ("value", "2")])[0][0] == "h"
    assert scanner.item([("name", "pressure [MPa]"), ("value", "0,2")])[0][:2] == ("MPa", 0.2)
    assert scanner.item([("name", "T"), ("value", "499"), ("unit", "К")])[0][0] == "K"
    assert scanner.item([("name", "temperature"), ("min", "10"), ("max", "20"), ("unit", "degF")]) == [("degF", 10.0, 20.0, 0.0)]
    assert scanner.item([("name", "flow rate"), ("value", "317"), ("unit", None)]) == []
    assert scanner.item([("name", None), ("value", None)]) == []


def test_whole(spark):
    rows = [
        ("a", ["leached at 212 F for 2 h", None, "under nitrogen"], [{"name": "pressure", "value": "2", "unit": "bar"}], "x", 1),
        ("a", ["leached at 212 F for 2 h", None, "under nitrogen"], [{"name": "pressure", "value": "2", "unit": "bar"}], "x", 1),
        ("b", None, None, None, None),
        (None, [], [{}], None, None),
        ("c", ["kept at 100 kPa"], None, None, None),
    ]
    targets = spark.createDataFrame([("temperature", "degC"), ("duration", "min"), ("pressure", "kPa"), ("pressure", "kPa")], "quantity string, common_unit string")
    got = units.to_common(units.find_quantities(spark.createDataFrame(rows, SCHEMA), "procedure_summary_id"), targets).collect()
    values = {(r["procedure_summary_id"], r["field_name"], r["item_pos"], r["quantity"]): (round(r["common_low"], 6), r["converted"]) for r in got}
    assert values == {("a", "conditions", 0, "temperature"): (100.0, True), ("a", "conditions", 0, "duration"): (120.0, True), ("a", "process_parameters", 0, "pressure"): (200.0, True), ("c", "conditions", 0, "pressure"): (100.0, False)}
    assert len(got) == 7  # the repeated row has its rows as well


def test_empty_and_long(spark):
    assert units.find_quantities(spark.createDataFrame([], SCHEMA), "procedure_summary_id").count() == 0
    long = spark.createDataFrame([("l", ["5 MPa " * 20000], None, None, None)], SCHEMA)
    assert units.find_quantities(long, "procedure_summary_id").count() == 20000
