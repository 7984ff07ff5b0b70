import pytest

from gleaner.llm import privacy as P
from tests.conftest import rows

TERMS = {"Beat": 5.0, "Anne-Lise": 5.0, "Urs": 5.0}
CONTEXTS = {"ansprechperson:": 0.9, "unser teamleiter": 0.9}

STRUCTURED = [
    ("Mail a.b+c@firma-x.example.", [("email", "a.b+c@firma-x.example")]),
    ("info at firma dot example senden", [("email", "info at firma dot example")]),
    ("x[at]firma[dot]example, ok", [("email", "x[at]firma[dot]example")]),
    ("x (at) firma.mail.test. Ausweis", [("email", "x (at) firma.mail.test")]),
    ('<a href="mailto:x@y.test">x@y.test</a>', [("email", "x@y.test"), ("email", "x@y.test")]),
    ("name&#64;host.example", [("email", "name&#64;host.example")]),
    ("Betreff @kestra und teams at Xanadoquo", []),
    ("Tel. 044 123 45 67, +41 (0)44 123 45 67", [("phone", "044 123 45 67"), ("phone", "+41 (0)44 123 45 67")]),
    ("Frau X ((039) 1860977) und (066.977.64.86)", [("phone", "(039) 1860977"), ("phone", "066.977.64.86")]),
    ("Stellennummer 04265 40 994, 08.00 bis 17.30 Uhr, UID CHE-120.853.216, Referenz 2063-0911-74", []),
    ("Artikel 7560000000011 gehört dazu", []),
    ("AHV-Nr. 756.1234.5678.97, Ausweis E1234567, numéro AVS S12R71A45", [("id_number", "756.1234.5678.97"), ("id_number", "E1234567"), ("id_number", "S12R71A45")]),
    ("Code E1234567 ohne Hinweis", []),
    ("Arbeitsort: Hinterdorfplatz 153b, 8000 Bern", [("address", "Hinterdorfplatz 153b")]),
    ("an der Bahnhöflistrasse mitten im Ort; rue du Marché, au centre", []),
    ("route de Pré-Fleury 125 c, 7878 X; viale dei Castagneti 186, 8055; Old Granary Road 16b, 4587; Am Sagenbach 9, 1", [("address", "route de Pré-Fleury 125 c"), ("address", "viale dei Castagneti 186"), ("address", "Old Granary Road 16b"), ("address", "Am Sagenbach 9")]),
    ("Im Schnitt 5 Mal pro Jahr, einen Parkplatz im Hof", []),
]


@pytest.mark.parametrize("text,want", STRUCTURED)
def test_structured(text, want):
    assert [(k, text[a:b]) for k, a, b in sorted(P.structured(text), key=lambda f: f[1])] == want


NAMES = [
    ("Frau oder Mann, jung oder erfahren", []),
    ("Für Auskünfte steht Ihnen Frau Müller unter", ["Müller"]),
    ("Dr. Anne-Lise von Rot (044)", ["Anne-Lise von Rot"]),
    ("Rufen Sie an: MUSTER-AST Urs, Leitung", ["MUSTER-AST Urs"]),
    ("Ansprechperson: S. Muster / x", ["S. Muster"]),
    ("dossier à M. R. Muster vous", ["R. Muster"]),
    ("Unser Teamleiter Beat Muster zeigt", ["Beat Muster"]),
    ("Herr P. Muster und Madame VON MUSTER Urs", ["P. Muster", "VON MUSTER Urs"]),
    ("Als Partner von Blumer & Keller Treuhand", []),
    ("die Muster Personal AG sucht", []),
]


@pytest.mark.parametrize("text,want", NAMES)
def test_names(text, want):
    assert [text[a:b] for a, b in P.names(text, TERMS, CONTEXTS)] == want


def test_corpus_teaches_names(spark):
    firsts = ["Beat", "Petra", "Gian"]
    data = [(i, f"Frau {firsts[i % 3]} Muster{chr(97 + i)} hilft. " + "Technische Pläne prüfen. " * 9, "z") for i in range(24)]
    data += [(100, "Gezeichnet wird hier von Petra Neumann persönlich. Technische Pläne", "z"), (101, None, "z"), (102, "", "z"), (103, "Technische Pläne", "z")]
    df = spark.createDataFrame(data, "id long, t string, findings string")
    done = {r.id: r for r in P.sanitised(df, key=["id"], text="t").collect()}
    assert [(f.kind, f.found_text) for f in done[100].findings] == [("name", "Petra Neumann")]
    assert done[100].clean_text == "Gezeichnet wird hier von [NAME] persönlich. Technische Pläne"
    assert done[101].clean_text is None and done[101].findings == [] and done[102].clean_text == "" and done[103].findings == []
    assert P.sanitised(df.limit(0), key=["id"], text="t").count() == 0


def test_large_lexicons_are_joined(spark):
    data = [(i, f"Frau {n} Muster{i} hilft. " + "Technische Pläne prüfen. " * 9) for i in range(5) for n in ("Beat", "Petra")]
    data += [(50, "Gezeichnet hat Petra Neumann. Technische Pläne"), (51, None), (52, "")]
    df = spark.createDataFrame(data, "id long, t string")
    small = sorted(map(str, P.sanitised(df, key=["id"], text="t").collect()))
    large = sorted(map(str, P.sanitised(df, key=["id"], text="t", max_terms=1).collect()))
    assert small == large and any("Petra Neumann" in x for x in large)


def test_redaction_keeps_the_rest():
    text = "Tel. 044 123 45 67, a@b.example."
    assert P.redact(text, P.find(text, {}, {})) == "Tel. [PHONE], [EMAIL]."


def test_query(spark, sf_dir):
    found = rows(P.p4_found(spark, sf_dir))
    assert len(found) == len(set(found)) and {f[2] for f in found} <= set(P.KINDS)


def test_labels_that_reveal_nobody(spark):
    """The corpus clears a label without persons near, that no list knows; others and rare ones stay."""
    data = [(i, f"Die Waren liegen bereit. Lagernummer 044 123 45 {i % 90 + 10} ist frei.") for i in range(150)]
    data += [(200 + i, f"Auskunft gibt Frau Muster. Durchwahl 044 765 43 {i % 90 + 10}, gerne am Morgen.") for i in range(150)]
    data += [(400, "Regalnummer 044 111 22 33 ist frei."), (401, "Lagernummer 044 123 45 10"), (402, None), (403, "")]
    df = spark.createDataFrame(data, "id long, t string")
    counts = P.observed(df, "t")
    assert [r.label for r in P.cleared_labels(counts).collect()] == ["lagernummer"]
    for bound in (500_000, 0):
        done = {r.id: [f.kind for f in r.findings] for r in P.sanitised(df, key=["id"], text="t", max_terms=bound).collect()}
        assert done[3] == done[401] == [] and "phone" in done[203] and done[400] == ["phone"]


def test_label_of():
    text = "Der Betrieb ist offen. AHV-Nr.: 756.1234.5678.97, Tel. 044 123 45 67"
    assert P.label_of(text, text.index("756")) == "ahv-nr" and P.label_of(text, text.index("044")) == "tel"


def test_rare_first_name_in_a_sure_context():
    text = "Auskunft erteilt gerne Ottokara Muster am Telefon."
    assert [text[a:b] for a, b in P.names(text, {}, {"auskunft erteilt gerne": 0.95})] == ["Ottokara Muster"]
    assert P.names(text, {}, {"auskunft erteilt gerne": 0.6}) == []
