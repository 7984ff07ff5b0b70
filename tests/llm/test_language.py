import random

from pyspark.sql import functions as F

from gleaner.llm import language as L
from tests.conftest import rows

TEXTS = {
    "de": ["Wir suchen eine Person mit Freude am Kontakt.", "Die Firma ist seit vielen Jahren in der Stadt tätig.", "Sie erhalten eine starke Pensionskasse und fünf Wochen Ferien.", "Das Gespräch findet in der Regel innert zwei Wochen statt."],
    "fr": ["Nous cherchons une personne qui aime le contact.", "La société est active depuis de nombreuses années dans la ville.", "Vous recevez une solide caisse de pension et cinq semaines de vacances.", "Le poste est libre de suite ou à convenir."],
    "it": ["Cerchiamo una persona che ama il contatto con i clienti.", "La ditta è attiva da molti anni in questa città.", "Offriamo una solida cassa pensione e cinque settimane di vacanza.", "Il nostro ufficio è in centro vicino alla stazione."],
    "en": ["We are looking for a person who loves the contact with clients.", "The company has been active in this town for many years.", "You get a solid pension fund and five weeks of holiday.", "The position is open immediately or by agreement."],
}


def model():
    return L.fit([" ".join(v[:3]) for v in TEXTS.values()], list(range(4)))


def test_code_separates_languages():
    distances = [(L.CODE[i] != L.CODE[j]).sum() for i in range(4) for j in range(i)]
    assert L.CODE.shape == (4, 7) and min(distances) == 4


def test_held_out_sentences():
    m = model()
    for k, lang in enumerate(L.LANGUAGES):
        p = m.decode(m.margins([TEXTS[lang][3]]))[0]
        assert p.argmax() == k and p[k] > 0.9


def test_wrong_labels_in_training():
    rng = random.Random(1)
    texts, labels = [], []
    for k, lang in enumerate(L.LANGUAGES):
        for _ in range(60):
            texts.append(" ".join(rng.sample(TEXTS[lang], 2)))
            labels.append(k if rng.random() > 0.25 else rng.randrange(4))
    m = L.fit(texts, labels)
    guess = m.decode(m.margins([TEXTS[x][3] for x in L.LANGUAGES])).argmax(axis=1)
    assert list(guess) == [0, 1, 2, 3]


def test_passages():
    m = model()
    german, french = " ".join(TEXTS["de"]), " ".join(TEXTS["fr"][:2])
    done = L.label_texts([german + "\n\n" + french, german + " Simply better together. " + TEXTS["de"][0], german, None, "", "  ", "123 456", TEXTS["fr"][0]], m)
    assert done[0][0] == "de" and [p[0] for p in done[0][3]] == ["fr"] and done[0][3][0][2] == 2
    assert done[1][0] == "de" and done[1][3] == [] and done[2][3] == []
    assert [d[0] for d in done[3:7]] == [None] * 4 and done[7][0] == "fr"


def test_labels(spark):
    df = spark.createDataFrame([("de-CH",), ("German",), ("EN",), ("fra",), ("und",), ("",), (None,), (" it ",)], "l string")
    assert [r[0] for r in df.select(L.known_label(F.col("l"))).collect()] == ["de", "de", "en", "fr", None, None, None, "it"]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "id long, label string, text string")
    m = L.train(df)
    assert L.languages_of(df, m, key="id", text="text").count() == 0
    one = spark.createDataFrame([(1, "x", "Wir sind in der Stadt und haben für Sie eine Stelle mit Zukunft."), (1, "x", None)], "id long, lang string, text string")
    assert rows(L.languages_of(one, m, key="id", text="text").select("lang").where("lang IS NOT NULL")) == [("de",)]


def test_query(spark, sf_dir):
    found = L.p6_found(spark, sf_dir)
    assert found.columns == ["id", "lang"] and found.count() == found.distinct().count()
    labels = L.p6_labels(spark, sf_dir).where("label IS NOT NULL AND lang IS NOT NULL")
    agree = labels.where("label = lang").count() / labels.count()
    assert agree > 0.85


def test_ties_are_flagged():
    bits = L.CODE[0].copy()
    assert not L.tied(bits, 0)
    bits[L.CODE[0] != L.CODE[1]] = 0.0  # nothing speaks for the one or the other
    assert L.tied(bits, 0)


def test_lists_of_short_items():
    model = L.fit([], [])
    german = "Wir suchen für die Abteilung eine Person, die mit uns und für die Kunden arbeitet und nicht nur eine Aufgabe haben will.\n"
    short = "- le service des soins\n- dans les ateliers\n- pour nos clients\n- avec vous\n- les plus belles\n- sur la route\n- et votre ville\n- par les rues\n"
    (done,) = L.label_texts([german * 6 + short], model)
    assert done[0] == "de" and [p[0] for p in done[3]] == ["fr"]
    (done,) = L.label_texts([german * 6 + "- avec vous\n"], model)
    assert done[3] == []


def test_training_is_bounded_and_whole(spark):
    text = {"de": L.SEEDS["de"] + " ", "fr": L.SEEDS["fr"] + " "}
    data = [(i, k, text[k] * (1 + i % 3)) for k in text for i in range(30)] + [(100, "de", text["de"] * 5000), (101, None, text["de"]), (None, "de", text["de"]), (5, "de", text["de"])]
    df = spark.createDataFrame(data, "id long, label string, text string")
    model = L.train(df, per_language=10)
    assert L.label_texts(["Wir sind nicht auf der Suche nach einer Stelle"], model)[0][0] == "de"
    assert L.train(df.limit(0)).margins(["und die"]).shape == (1, L.CODE.shape[1])
