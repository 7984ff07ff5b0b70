import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import cast, geo, language, pii, text
from gleaner.functions import fixed_values as V
from gleaner.operators import requirements


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first().x


TITLES = [
    ("Fachmann Gesundheit EFZ (m/w/d) in Erlenbach gesucht", "Erlenbach", "fachmann gesundheit efz"),
    ("Logistiker 100% (m/w/d)", None, "logistiker"),
    ("Logistiker*in 80-100%", None, "logistiker"),
    ("Medizin", None, "medizin"),
    ("Finance &amp; HR", None, "finance & hr"),
    ("Koch – wir sind ein tolles Team", "", "koch"),
    ("", "Bern", ""),
    (None, "Bern", None),
]


@pytest.mark.parametrize("title,city,want", TITLES)
def test_titles(spark, title, city, want):
    df = spark.createDataFrame([(title, city)], "t string, c string")
    assert df.select(text.normalize_title(F.col("t"), F.col("c")).alias("x")).first().x == want


@pytest.mark.parametrize("name,want", [("VAT Group AG", "vat"), ("Group AG", ""), ("Müller & Co. Sàrl", "müller"), (None, None)])
def test_companies(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.normalize_company(F.col("n")).alias("x")).first().x == want


def test_cleaning(spark):
    df = spark.createDataFrame([("<p>A&nbsp;b</p>\n c d", "80\\-100% \\& mehr", "a &#228; &auml; &unknown; &amp; &#x41;")], "h string, m string, e string")
    r = df.select(text.strip_html(F.col("h")).alias("h"), text.unescape_markdown(F.col("m")).alias("m"), text.unescape_entities(F.col("e")).alias("e")).first()
    assert (r.h, r.m, r.e) == ("A&nbsp;b c d", "80-100% & mehr", "a ä ä &unknown; & A")


def test_workload(spark):
    df = spark.createDataFrame([("Koch 60 %", 100, 100), ("Koch 80-100%", 80, 100), ("Koch 60%", None, 100), ("Koch 0%", 50, 50), (None, 1, 2)], "t string, lo int, hi int")
    lo, hi, flag = text.reconcile_workload(F.col("t"), F.col("lo"), F.col("hi"))
    assert [tuple(r) for r in df.select(lo, hi, flag).collect()] == [(60, 60, True), (80, 100, False), (None, 100, False), (50, 50, False), (1, 2, False)]


def test_urls_hashes_blocks(spark):
    df = spark.createDataFrame([("https://www.Firma.example/Job/1/?utm=x", "8000", "Bern"), ("#", "", "Bern"), (None, None, None)], "u string, p string, c string")
    assert [tuple(r) for r in df.select(text.url_key(F.col("u")), text.dedup_block(F.col("p"), F.col("c"))).collect()] == [("firma.example/job/1", "8000"), (None, "bern"), (None, "?")]
    assert len(one(spark, text.content_hash(F.lit("a"), F.lit("<p>b</p>")))) == 32


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), (None,), ("a a a a a a a",)], "t string")
    assert [r[0] for r in df.select(text.shingles(F.col("t"))).collect()] == [["a b c d e", "b c d e f"], ["a b"], [], [], ["a a a a a"]]


def test_sections(spark):
    body = "Wir sind toll.\nIhre Aufgaben\n- eins\nWir bieten\n- Geld\nIhr Profil\n- zwei\nKontakt\nAnruf"
    assert one(spark, text.extract_relevant(F.lit(body))).split("\n") == ["Ihre Aufgaben", "- eins", "Wir bieten", "- Geld", "Ihr Profil", "- zwei"]
    assert one(spark, text.extract_relevant(F.lit("ohne Titel"))) == "ohne Titel"


def test_quote_and_labels(spark):
    long = "wort " * 30 + "Gleitzeit ist möglich " + "ende " * 30
    said = one(spark, text.quote(F.lit(long), V.FLEXTIME))
    assert said.startswith("… ") and said.endswith(" …") and "Gleitzeit" in said
    assert one(spark, text.quote(F.lit("nichts"), V.FLEXTIME)) is None
    assert one(spark, text.date_label(F.lit("2025-09-01").cast("date"))) == "Montag, 01.09.2025"
    assert one(spark, text.workload_label(F.lit(60), F.lit(100))) == "60-100%"


def test_casts(spark):
    df = spark.createDataFrame([("12.9", "2025-01-02T03:04:05Z"), ("", "2025-01-02 x"), ("abc", None), (None, "kaputt"), ("NaN", "2025-01-02")], "n string, d string")
    got = [(r[0], r[1], str(r[2]) if r[2] else None) for r in df.select(cast.to_int(F.col("n")), cast.to_float(F.col("n")), cast.to_datetime(F.col("d"))).collect()]
    assert got[0] == (12, 12.9, "2025-01-02 03:04:05")
    assert got[1] == (None, None, "2025-01-02 00:00:00")
    assert got[2][0] is None and got[3][2] is None and got[4][0] is None


def test_language(spark):
    german = "Wir sind ein Team und haben mit der Arbeit für die Kunden nach dem Sommer sowie bei uns"
    french = "Nous sommes une équipe et pour vous dans le bureau avec les clients qui sont chez nous"
    df = spark.createDataFrame([(german,), (french,), ("kurz",), (None,)], "t string")
    assert [r[0] for r in df.select(language.detect_language(F.col("t"))).collect()] == ["de", "fr", None, None]


def test_contact_data(spark):
    df = spark.createDataFrame([("Mail an anna.muster@firma.example, Tel. 044 123 45 67",), (None,)], "t string")
    assert [r[0] for r in df.select(pii.redact_text(F.col("t"))).collect()] == ["Mail an [E-Mail entfernt], Tel. [Telefon entfernt]", None]
    urls = spark.createDataFrame([("https://a.example/x",), ("ftp://a.example",), ("https://u@a.example",), ("javascript:1",), (None,)], "u string")
    assert [r[0] for r in urls.select(pii.safe_form_url(F.col("u"))).collect()] == ["https://a.example/x", None, None, None, None]
    doc = '{"id":"1","company":{"phone":"044 123 45 67","name":"A"},"text":["a@b.example"],"applyChannel":{"x":1}}'
    r = spark.createDataFrame([(doc,), ("{broken",), (None,)], "j string").select(pii.scrub_json("j"), pii.contact_leaks("j")).collect()
    assert r[0][0] == '{"id":"1","company":{"name":"A"},"text":["[E-Mail entfernt]"]}'
    assert sorted(r[0][1]) == ["applyChannel", "company.phone", "text[0]"] and r[1][0] is None and r[2][1] is None


def test_typed_scrub(spark):
    a = {"id": "abc-123", "owner": {"x": 1}, "jobCenterUserId": "u-77", "ref_number": "044 123 45 67", "jobContent": {
        "externalUrl": "http://a.muster@firma.example", "company": {"name": "Muster AG", "phone": "044 123 45 67", "email": "a@b.example", "surrogate": True},
        "jobDescriptions": [{"title": "Koch", "description": "Mail an a@b.example oder 044 123 45 67"}],
        "applyChannel": {"emailAddress": "a@b.example", "phoneNumber": "1", "rawPostAddress": "x", "formUrl": " https://muster.example/bewerben ", "additionalInfo": "Phil"},
        "publicContact": {"firstName": "B"}}}
    b = {"id": 7, "title": "Koch", "contact": "<p>Anna, 044 123 45 67</p>", "url_application": "mailto:a@b.example", "url_description": "https://b.example/1", "extraLink": "mailto: a@b.example", "company": {"description": "044 123 45 67", "homepage": "https://b.example/0441234567"}}
    row = spark.createDataFrame([(json.dumps(a), json.dumps(b), "[1]", "{x")], "a string, b string, c string, d string")
    got = row.select(pii.scrub_source_a("a"), pii.scrub_source_b("b"), pii.scrub_source_a("c"), pii.scrub_source_b("d")).first()
    x, y = json.loads(got[0]), json.loads(got[1])
    content = x["jobContent"]
    assert set(x) == {"id", "ref_number", "jobContent"} and x["ref_number"] == "[Telefon entfernt]" and content["externalUrl"] is None
    assert set(content) == {"externalUrl", "company", "jobDescriptions", "applyChannelFlags"} and content["company"] == {"name": "Muster AG", "surrogate": True}
    assert content["applyChannelFlags"] == {"apply_via_email": True, "apply_via_phone": True, "apply_via_post": True, "form_url": "https://muster.example/bewerben"}
    assert content["jobDescriptions"][0]["description"] == "Mail an [E-Mail entfernt] oder [Telefon entfernt]"
    assert y["has_contact_person"] is True and "contact" not in y and y["url_application"] is None and y["url_description"] == "https://b.example/1"
    assert y["extraLink"] == "mailto: [E-Mail entfernt]" and y["company"] == {"description": "[Telefon entfernt]", "homepage": "https://b.example/0441234567"}
    assert got[2] is None and got[3] is None
    left = row.select(pii.scrub_source_a("a").alias("j")).unionByName(row.select(F.col("a").alias("j")))
    assert [len(r.leaks) > 0 for r in pii.rescrub(left, "j", check=True).collect()] == [True]
    assert pii.rescrub(pii.rescrub(left, "j"), "j", check=True).count() == 0


def test_clauses_and_places_of_matches(spark):
    langs = lambda t: one(spark, requirements.required_languages(F.lit(t)))
    assert langs("Franz. Kenntnisse zwingend") == {"fr": 0.5}
    assert langs("Deutsch, Französisch zwingend, Englisch von Vorteil") == {"fr": 1.0, "en": 0.0}
    far = "x" * 300
    assert one(spark, requirements.education(F.lit(f"An der FHNW idealerweise. {far} Abschluss FH zwingend"))[1]) is False
    assert one(spark, text.quote(F.lit(f"Abc Gleitzeitkonto {far} gleitzeit"), "gleitzeit\\b")).endswith("gleitzeit")


def test_distances(spark):
    km = one(spark, geo.haversine_km(F.lit(47.3769), F.lit(8.5417), F.lit(46.948), F.lit(7.4474)))
    assert 90 < km < 100
