import numpy as np

from lodeline.llm import language as L

TEXTS = {
    "en": ["The measurements were repeated several times and the results stayed within limits.", "Further tests on the molten slag are planned for the next year.", "Water from the pond was treated with lime before it left the plant."],
    "ru": ["Измерения повторены несколько раз, и результаты остаются в допустимых пределах.", "Дополнительные испытания шлака запланированы на следующий год.", "Вода из пруда обработана известью перед сбросом с предприятия."],
    "de": ["Die Messungen wurden mehrmals wiederholt, und die Ergebnisse blieben innerhalb der Grenzen.", "Weitere Versuche mit der Schlacke sind für das nächste Jahr geplant.", "Das Wasser aus dem Teich wurde vor der Einleitung mit Kalk behandelt."],
    "fr": ["Les mesures ont été répétées plusieurs fois et les résultats sont restés stables.", "Des essais supplémentaires sur le laitier sont prévus pour l’année prochaine.", "L’eau du bassin a été traitée avec de la chaux avant de quitter le site."],
    "es": ["Las mediciones se repitieron varias veces y los resultados se mantuvieron estables.", "Están previstos más ensayos con la escoria durante el próximo año.", "El agua del estanque se trató con cal antes de salir de la planta."],
    "uk": ["Вимірювання повторено кілька разів, і результати залишаються в допустимих межах.", "Додаткові випробування шлаку заплановано на наступний рік.", "Воду зі ставка оброблено вапном перед скиданням із підприємства."],
}


def frame(spark):
    rows = []
    for lang, texts in TEXTS.items():
        rows += [(f"{lang}{i}{k}", lang if k else lang.upper(), None if i == 2 else t, t, "q") for i, t in enumerate(texts) for k in range(4)]
    rows += [("mix", "en", TEXTS["en"][0] + " " + TEXTS["ru"][1], "t", "q"), ("mixed", "Mixed", TEXTS["de"][0] + "\n\n" + TEXTS["fr"][1], "t", "q"), ("none", None, TEXTS["fr"][0], "t", "q"), ("und", "und", TEXTS["es"][1], "t", "q"), ("wrong", "ru-RU", TEXTS["uk"][0], "t", "q")]
    rows += [("fine", "English", TEXTS["en"][0] * 500, "t", "q"), ("null", "en", None, None, "q"), ("digits", "en", "12 34", "", "q"), ("wrong", "ru-RU", TEXTS["uk"][0], "t", "q")]
    return spark.createDataFrame(rows, "publication_id string, language string, abstract string, title string, segment string")


def test_wrong_labels(spark):
    seg = L.segments(frame(spark), "publication_id", "language", "abstract", "title")
    got = {(r["publication_id"], r["language"]) for r in L.wrong_labels(seg).collect()}
    assert got == {("mix", "en"), ("mix", "ru"), ("none", "fr"), ("und", "es"), ("wrong", "uk")}
    null = seg.where("publication_id = 'null'").first()
    assert null["language"] is None and null["confidence"] == 0
    assert seg.where("publication_id = 'mixed'").count() == 2


def test_labels():
    assert L.canonical("en-GB") == "en" and L.canonical("русский") == "ru" and L.canonical("n/a") is None and L.canonical(None) is None


def test_short_sentence_follows_its_neighbours():
    strong, weak, other = [2.0, 0.5], [0.4, 0.6], [0.5, 1.5]
    assert L.smoothed(np.array([strong, weak, strong]), 0.2) == [0, 0, 0]
    assert L.smoothed(np.array([strong, other, weak, strong]), 0.2) == [0, 1, 1, 0]
    assert L.smoothed(np.array([weak]), 0.2) == [1]


def test_trigrams_have_no_bound(spark):
    """More trigrams than any alphabet has: prototypes are summed in tasks, whatever their number."""
    rows = [("".join(chr(0x4E00 + (7 * i + 13 * j) % 20_000) for j in range(40)), "en" if i % 2 else "ru") for i in range(200)]
    df = spark.createDataFrame(rows, "t string, l string")
    p = L.train(df, "l", "t")
    assert p.shape == (len(L.LANGUAGES), L.DIM) and np.isfinite(p).all() and abs(p[:2]).sum() > 0


def test_sentences():
    assert L.sentences("One two three four. Five six seven. No 3.") == ["One two three four.", "Five six seven. No 3."]
    assert L.sentences("") == []


def test_empty(spark):
    assert L.segments(frame(spark).limit(0), "publication_id", "language", "abstract", "title").count() == 0
