import random

from lodeline.llm import subjects as S

WORDS = {"water": "membrane sulphate permeate clarifier sludge", "mining": "stope blasting haulage drift shaft", "law": "court licence statute plaintiff clause"}
SCHEMA = "doc_id bigint, text string, subject string, share string"


def corpus(spark):
    r = random.Random(1)
    sentence = lambda s: f"The {r.choice(WORDS[s].split())} and the {r.choice(WORDS[s].split())} were examined in {r.randint(1990, 2020)}."
    docs, labels = [], []
    for i in range(240):
        s = list(WORDS)[i % 3]
        docs.append((i, " ".join(sentence(s) for _ in range(6)), "q", "q"))
        if i < 150:
            labels.append((i, s if i % 25 else "law"))  # some labels are wrong
    docs += [(1000, " ".join([sentence("water")] * 4 + [sentence("law")] * 4), "q", "q"), (1001, None, "q", "q"), (1002, "", "q", "q"), (1003, "— —", "q", "q"), docs[200], (1004, " ".join(sentence("mining") for _ in range(2000)), "q", "q")]
    labels += labels[:5] + [(None, "law"), (3, None), (77777, "water")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, subject string")


def test_held_out(spark):
    docs, labels = corpus(spark)
    got = {}
    for r in S.subject_shares(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append(r["subject"])
    right = sum(got.get(i) == [list(WORDS)[i % 3]] for i in range(150, 240) if i != 200)
    assert right >= 86
    assert sorted(got[1000]) == ["law", "water"] and got[1004] == ["mining"]
    assert got[200] == [list(WORDS)[200 % 3]] * 2 and {1001, 1002, 1003}.isdisjoint(got)


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark)
    assert S.subject_shares(docs, labels.limit(0)).count() == 0
    assert S.subject_shares(docs.limit(0), labels).count() == 0
