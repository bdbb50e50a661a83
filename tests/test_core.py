import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import chunking, graph, joins, quality, search
from lodeline.operators.prefix import running_sum
from lodeline.sources import documents, files


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, lambda x: T.compact(x, 10), " a  b\nc d e f g ") == "a b c d..."
    assert one(spark, lambda x: T.compact(x, 10), None) is None
    assert one(spark, lambda x: T.tokens(x), "Ni-20, Straße; +x+ a") == ["ni-20", "strasse"]
    assert one(spark, lambda x: T.prepared(x, 12, 99), "one two. three four") == "one two. "[:9]
    assert one(spark, lambda x: T.ngrams(T.words(x), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda x: T.ngrams(T.words(x), 2), "a") == []
    assert one(spark, lambda x: T.script_language(x), "") == "unknown"
    assert one(spark, lambda x: T.script_language(x), "руда ore ore") == "mixed"
    assert one(spark, lambda x: T.has_term(x, "ni"), "nickel and ni, cu") is True
    assert one(spark, lambda x: T.has_term(x, "ni"), "nickel") is False


def windows(spark, text, **how):
    df = spark.createDataFrame([(1, text, "q")], "i int, t string, chunk string")
    return [r["chunk"] for r in chunking.window_chunks(df, "i", "t", **how).orderBy("chunk_index").collect()]


def test_windows_always_advance(spark):
    got = windows(spark, "a" * 350 + "\n" + "b" * 5000)
    assert len(got) < 100 and all(len(x) <= 3500 for x in got) and got[-1].endswith("b")
    assert windows(spark, "x" * 299) == [] and windows(spark, "x" * 300) == ["x" * 300]
    assert windows(spark, " \n \n") == [] and windows(spark, None) == [] and windows(spark, "") == []


def test_windows_end_at_boundaries(spark):
    got = windows(spark, "  aaaa. bbbb\n\n cccc. dddd ", target=12, overlap=2, least=3)
    assert got == ["aaaa. bbbb", "b\ncccc. dddd"]


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 1001, "q"), (2, None, "q"), (3, "", "q"), (4, "b", "q")], "doc_id int, text string, chunk string")
    got = {(r["doc_id"], r["chunk_no"]): len(r["chunk"]) for r in chunking.fixed_chunks(df, "doc_id", "text", 1000, 800).collect()}
    assert got == {(1, 0): 1000, (1, 1): 201, (4, 0): 1}


def test_bm25(spark):
    df = spark.createDataFrame([(1, "nickel ore"), (2, "copper ore"), (3, None), (4, "nickel nickel ore water salt")], "i int, t string")
    assert [r["row_id"] for r in search.bm25(df, "i", "t", "nickel", 5).collect()][0] in (1, 4)
    assert search.bm25(df, "i", "t", "", 5).count() == 0
    assert search.bm25(df, "i", "t", "nickel", 0).count() == 0
    assert search.bm25(df.limit(0), "i", "t", "nickel", 3).count() == 0


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)] + [(99, None)], "id int, v array<double>")
    got = search.nearest(df, df.where("id < 5"), "id", "v", 4).collect()
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-float(m[q] @ m[i]), i))[:4]
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_similar_sets_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    a = [(i, r.sample("abcdefgh", r.randint(1, 6))) for i in range(40)] + [(90, None), (91, [])]
    b = [(i, r.sample("abcdefgh", r.randint(1, 6))) for i in range(40)]
    da, db = spark.createDataFrame(a, "i int, t array<string>"), spark.createDataFrame(b, "j int, t array<string>")
    for least in (0.5, 0.8, 1.0):
        got = {(x["i"], x["j"]) for x in joins.similar_sets(da, db, "i", "j", "t", least).collect()}
        want = {(i, j) for (i, s), (j, t) in itertools.product(a[:40], b) if len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
        assert got == want


def test_running_sum(spark):
    df = spark.createDataFrame([("a", i, i // 3) for i in range(10)], "g string, v int, b int")
    got = {r["v"]: r["s"] for r in running_sum(df, ["g"], "b", [F.col("v")], "v", "s").collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(10)}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 2), ("c", "a", "t", 3), ("a", "a", "t", 4), ("a", None, "t", 5), ("a", "b", "t", 6), ("c", "d", "t", 7), ("d", "e", "t", 8)], "source_id string, target_id string, type string, seq int")
    m = graph.merge_edges(e)
    assert m.count() == 5 and m.where("mentions = 2").count() == 1
    p = graph.paths(m, spark.createDataFrame([("a",)], "node_id string"), 3).collect()
    assert all(len(set(r["path"])) == len(r["path"]) for r in p) and max(r["depth"] for r in p) == 3
    assert not any(r["end_id"] == "e" and r["depth"] > 3 for r in p)


def test_gate_of_nothing_fails(spark):
    f = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert {r["check"]: r["passed"] for r in quality.gate(f, {"x": F.col("a") > 0, "y": F.col("b") > 0}).collect()} == {"x": False, "y": True}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\nnot json\n[1]\n{"a": 2}\n', "utf-8")
    got = files.read_jsonl_checked(spark, str(p), "a int, b string").collect()
    assert sorted((r["a"], r["_error"]) for r in got if r["a"]) == [(1, None), (2, None)] and {r["_error"] for r in got} == {None, "not json", "[1]"}
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    files.write_csv(spark.createDataFrame([(1, [2])], "z int, a array<int>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "z"]


def test_documents(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.html").write_text("<html><title>T &amp; U</title><script>no</script><p>One<br>two</p><table><tr><td>1</td><td>2</td></tr></table></html>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (d / "c.docx").write_bytes(b"broken")
    (d / "d.pdf").write_bytes(b"%PDF")
    (d / "e.gif").write_bytes(b"GIF89a\x02\x00\x03\x00")
    (d / "f.rtf").write_bytes(rb"{\rtf1 Caf\'e9 \par next}")
    got = {r["extension"] + r["local_path"][-6]: r for r in files.read_documents(spark, str(d)).collect()}
    by = {r["local_path"].rsplit("/", 1)[1]: r for r in got.values()}
    assert by["a.html"]["title"] == "T & U" and "no" not in by["a.html"]["text"].split() and by["a.html"]["n_tables"] == 1
    assert by["b.docx"]["text"] == "Hello\nx | y"
    assert by["c.docx"]["status"] == "failed" and by["c.docx"]["error"]
    assert by["d.pdf"]["status"] == "unsupported" and by["e.gif"]["text"] == "gif 2x3" and by["f.rtf"]["text"].split("\n")[1] == "next"
    assert documents.parse("x.docx", None)[2] == "failed"


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {(r["k"], r["v"]) for r in files.upsert(a, b, "k").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert [r["k"] for r in files.resume(b, a, "k").collect()] == [3]


def test_stream(spark, tmp_path):
    from lodeline.streaming import jobs

    src = tmp_path / "src"
    spark.createDataFrame([(1, "nickel ore " * 40), (2, "copper")], "doc_id int, text string").write.parquet(str(src))
    s = jobs.source(spark, str(src), "doc_id int, text string")
    for _ in range(2):  # the second run finds nothing new
        jobs.index_documents(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = jobs.latest(spark, str(tmp_path / "out/postings"), "row_id")
    assert got.where("term = 'nickel'").first()["tf"] == 40 and got.select("row_id").distinct().count() == 2


@pytest.mark.parametrize("bad", [None, "", "{"])
def test_json_fallback(spark, bad):
    df = spark.createDataFrame([(bad,)], "p string")
    assert df.select(F.get_json_object("p", "$.k")).first()[0] is None
    assert json.dumps(bad) is not None


def test_stored_tables_are_shared_and_cleared(spark):
    from lodeline import runtime

    df = runtime.stored(spark.createDataFrame([(1, None), (2, [3])], "a int, b array<int>"))
    assert sorted(r["a"] for r in df.collect()) == [1, 2] and "/lodeline-" in df.inputFiles()[0]
    assert runtime.clear(spark) and not runtime.clear(spark)


def test_scope_deletes_its_tables(spark):
    from lodeline import runtime

    with runtime.scope(spark):
        df = runtime.stored(spark.range(3))
        assert df.count() == 3
        folder = df.inputFiles()[0].rpartition("/")[0]
    assert not spark._jvm.java.io.File(folder.removeprefix("file://").removeprefix("file:")).exists()


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodeline import runtime

    bare = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]", applicationId="x"))
    with pytest.raises(ValueError):
        runtime.shared_dir(bare)
