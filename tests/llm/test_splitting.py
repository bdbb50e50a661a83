import hypothesis.strategies as st
from hypothesis import given, settings

from lodeline.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. Next ", "\n", "\n\n", "x" * 40, "a, b ", "юж; "]), max_size=120), st.integers(20, 90))
def test_pieces_hold_everything(parts, limit):
    text = "".join(parts)
    overlap = limit // 8
    p = S.pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(e - s <= limit for s, e in p)
    assert all(b[0] == a[1] - overlap for a, b in zip(p, p[1:]))
    assert "".join(text[s + (overlap if i else 0) : e] for i, (s, e) in enumerate(p)) == text


def test_prefers_strong_boundaries():
    text = "a b c. D e f. " * 150 + "\n\n" + "G h i. J k l. " * 150
    (_, end), _ = S.pieces(text, 3500, 400)
    assert text[:end].endswith("\n\n")


def test_hard_cut():
    p = S.pieces("x" * 9000, 3500, 400)
    assert len(p) == 3 and max(e - s for s, e in p) <= 3500


def test_table(spark):
    rows = [(1, None, 5, "q"), (2, "", 5, "q"), (3, "short", None, "q"), (4, "one two. " * 1000, None, "q"), (4, "one two. " * 1000, None, "q"), (5, "ы" * 3500, 1, "q")]
    df = spark.createDataFrame(rows, "result_id bigint, text string, chunk_index int, start string")
    got = S.split_oversized(df, "result_id").collect()
    assert {r["result_id"] for r in got} == {4} and len(got) == 6
    one = sorted(r["chunk_index"] for r in got)
    assert one == [0, 0, 1, 1, 2, 2] and all(len(r["text"]) <= 3500 for r in got)
    assert S.split_oversized(df.limit(0), "result_id").count() == 0
