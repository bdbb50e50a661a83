from lodeline.llm import scanned as S

LINE = "The settler was tapped every hour and the molten metal was sampled twice before the measurement started."


def test_misread_cost():
    assert S.misread_cost("rnetal", "metal") == S.CHEAP
    assert S.misread_cost("cath0dc", "cathode") == 2 * S.CHEAP
    assert S.misread_cost("model", "metal") >= 1


def test_deletes():
    assert S.deletes("abc", 1) == {"abc", "ab", "ac", "bc"}


def test_running_lines():
    assert S.running_lines("one two\n— 12 —\nthree") == [1]
    assert S.running_lines("one two\nPage 4 of 9\nthree") == [1]
    assert S.running_lines("it was\nA RUNNING HEADER LINE\nfound there.") == [1]
    assert S.running_lines("12.5\n14\n15.1") == []
    assert S.running_lines("- exposure of operators:\n97\n- fall: 6") == []
    assert S.running_lines("A HEADING\n\nText follows.") == []
    assert S.running_lines("") == []
    assert S.running_lines("in the following days the molten slag was\nстр. 9\nAnnals of Northern Mines\ncooled slowly.") == [1, 2]
    assert S.running_lines("It was cooled.\n- 9 -\nThe slag was cooled\nslowly.") == [1]
    assert S.running_lines("Sample | Ni\nore | 1.2\n- 244 -\nJournal of Mining", True) == [2, 3]


def test_compounds_keep_their_hyphen():
    assert not S.broken_words("at low-\ntemperature", {"low-temperature"})
    assert S.broken_words("a measure-\nment", {"low-temperature"})
    assert S.broken_words("a meas\xad\nurement", set())


def test_confusions_share_a_key():
    for read, printed in (("rnodcrn", "modern"), ("c1ear", "clear"), ("vvater", "water"), ("рудн0го", "рудного"), ("cath0dc", "cathode"), ("rnrnetcr", "mmeter")):
        assert S.canonical(read) == S.canonical(printed)
    assert S.canonical("metal") != S.canonical("model")


def test_open_lines():
    text = "the molten slag was cooled in the pond and then\nSlag and Matte Bulletin\nmoved to the heap beside the old shaft."
    assert [x for _, x in S.open_lines(text)] == ["Slag and Matte Bulletin"]
    assert not list(S.open_lines("It ended.\nSlag and Matte Bulletin\nmoved to the heap.")) and not list(S.open_lines(""))


def test_paragraphs():
    assert S.paragraphs("was 9 % .The next ,one") == "was 9 %. The next, one"
    assert S.paragraphs("a b\nc d\n\n1. x\n2. y") == "a b c d\n\n1. x\n2. y"


def test_repair(spark):
    rows = [(i, LINE + f" Run {i}.", "q") for i in range(60)]
    rows += [(100, LINE.replace("molten metal", "molten rnetal").replace("measurement", "measure-\nment"), "q"), (100, LINE.replace("molten metal", "molten rnetal"), "q")]
    rows += [(101, None, "q"), (102, "", "q"), (103, LINE.replace(" ", "\n", 3), "q"), (104, "z" * 200_000, "q"), (105, LINE + "\n[12]\n" + LINE, "q")]
    r = spark.createDataFrame(rows, "result_id bigint, text string, breaks string")
    t = spark.createDataFrame([("t1", "Sample | Ni\nmetal | 1S.45"), ("t2", "Sample | Ni\nmetal | 15.45"), ("t3", None)], "table_id string, text string")
    got = S.repair({"retrieval_results": (r, "result_id", "text"), "parsed_tables": (t, "table_id", "text")}, {"parsed_tables"}).collect()
    assert sorted((x["table_name"], x["record_id"]) for x in got) == [("parsed_tables", "t1"), ("retrieval_results", "100"), ("retrieval_results", "100"), ("retrieval_results", "105")]
    fixed = [x["repaired"] for x in got if x["record_id"] == "100"]
    assert fixed == [LINE, LINE]
    assert next(x["repaired"] for x in got if x["record_id"] == "t1").endswith("15.45")


def test_empty(spark):
    r = spark.createDataFrame([], "result_id bigint, text string")
    assert S.repair({"retrieval_results": (r, "result_id", "text")}).count() == 0


def doubtful(spark):
    rows = [(i, LINE.replace("molten metal", f"molten metal at low temperature {i}"), "q") for i in range(40)]
    rows += [(200 + k, f"Run {k} ended in the pond where the sampled metal was cooled and then\nSlag and Matte Bulletin\nmoved to the old heap beside the settler, test {k}.", "q") for k in range(3)]
    rows += [(300, LINE.replace("molten metal", "low-\ntemperature"), "q"), (301, LINE.replace("measurement", "measure-\nment"), "q")]
    rows += [(400 + k, LINE.replace("molten metal", "molten rnetal"), "q") for k in range(60)]  # copies have no more say than one text
    return spark.createDataFrame(rows, "result_id bigint, text string, breaks string")


def test_no_size_decides(spark, monkeypatch):
    """Few or many words in the tasks' own set: the same records and texts."""
    seen = []
    for most in (S.MAX_COMMON, 10, 0):
        monkeypatch.setattr(S, "MAX_COMMON", most)
        seen.append(sorted((r["record_id"], r["repaired"]) for r in S.repair({"r": (doubtful(spark), "result_id", "text")}).collect()))
    assert seen[0] == seen[1] == seen[2]
    assert {k for k, _ in seen[0]} == {"200", "201", "202", "301", *(str(400 + k) for k in range(60))}
    assert all("Bulletin" not in t for k, t in seen[0] if k.startswith("20"))
