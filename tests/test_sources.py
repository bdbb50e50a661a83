import json

from lodeline.sources import connectors, files


def test_connector(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"message": {"items": [{"title": ["T"], "DOI": "https://doi.example/10.5555/X.1.", "issued": {"date-parts": [[2020, 1]]}}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"display_name": "U", "publication_year": 1999, "abstract_inverted_index": {"two": [1], "one": [0]}}, "odd"]}))
    (tmp_path / "c.json").write_text("{broken")
    connectors.register(spark)
    got = {r["source"]: r for r in spark.read.format("lodeline_records").option("path", str(tmp_path)).load().collect()}
    assert (got["a"]["title"], got["a"]["doi"], got["a"]["year"]) == ("T", "10.5555/x.1", 2020)
    assert got["b"]["abstract"] == "one two" and got["c"]["error"]


def test_sheets(spark):
    meta = json.dumps({"sheets": [{"sheet_index": 0, "sheet_name": "S", "rows": "7", "columns": "x", "csv_path": "C:\\w\\data\\parsed\\spreadsheets_csv\\a\\b.csv"}, None]})
    df = spark.createDataFrame([("d", meta), ("", meta), ("e", "{bad"), ("f", None), ("g", "{}")], "doc_id string, metadata_json string")
    assert [tuple(r) for r in files.explode_sheets(df).collect()] == [("d", 0, "S", 7, 0, "a/b.csv")]


def test_csv_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('metal,year\n" Nickel ",2012\nCopper,2011,extra\n', "utf-8-sig")
    rows = files.read_csv_rows(spark, str(tmp_path))
    s = files.table_summary(rows).first()
    assert (s["columns"], s["rows"], s["header"]) == (3, 2, "metal | year")
    p = {r["row_no"]: (r["cells"], r["truncated"]) for r in files.preview(rows, 2, 2).collect()}
    assert p == {1: (["metal", "year"], False), 2: (["Nickel", "2012"], False)}


def test_head_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("a\n\nb\nc\n")
    assert [(r["line_no"], r["value"]) for r in files.head_lines(spark, str(tmp_path / "x.jsonl"), 3).collect()] == [(1, "a"), (2, ""), (3, "b")]
