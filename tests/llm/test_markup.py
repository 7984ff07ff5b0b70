import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import markup
from tests.conftest import rows

CASES = [
    ("- ein\n* zwei\n+ drei\n– vier", []),
    ("C# oder C++ & SQL, 5 * 8 Stunden, ~80 %, [optional] mehr, auftrag_nr und kunden_id", []),
    ("Einkauf bis 50'000 $ pro Jahr, Reisen bis 5'000 $", []),
    ("Auch mit < 3 Jahren, Teams mit > 10 Personen, A <-> B", []),
    ("Kund*innen und Mitarbeiter*innen", []),
    ("C:\\Daten\\neu", []),
    ("a &amp; b", ["html"]),
    ("R&D; und Q&A", []),
    ("<!-- x -->", ["html"]),
    ("<style>p{margin:0}</style>Text", ["html"]),
    ("zum 28\\. Dienstjahr", ["markdown"]),
    ("**fett** und *kursiv*", ["markdown"]),
    ("Titel\n-----\nText", ["markdown"]),
    ("> Zitat", ["markdown"]),
    ("| a | b |\n|---|---|\n| c | d |", ["markdown"]),
    ("[Text](https://a.example)", ["markdown"]),
    ("<https://a.example>", ["markdown"]),
    ("```\n<b>{{x}}</b> \\textbf{y}\n```", ["markdown"]),
    ("<pre><code>**x** {{y}} \\a{b}</code></pre>", ["html"]),
    ("[[Merkblatt]]", ["wiki"]),
    ("== Titel ==\n** ein\n** zwei", ["wiki"]),
    ("'''fett'''", ["wiki"]),
    ("{{Hinweis|x}}", ["wiki"]),
    ("\\begin{itemize}\\item C\\# \\& SQL\\end{itemize}", ["latex"]),
    ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", ["latex"]),
    ("Kennzahl: $x^{2} + y_{n}$", ["latex"]),
    ("$$\\sum_i w_i$$ und 20\\. Tag", ["markdown", "latex"]),
    ("\\[x^2\\]", ["latex"]),
    ("<p>a</p>\n\n### Titel", ["html", "markdown"]),
    ("unclosed <b und ``` und {{ und $x", []),
    ("", []),
    ("   ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_families(text, want):
    assert markup.convert(text)[0] == want


def test_structure():
    text = "<h2>Aufgaben</h2><ul><li>eins &amp; zwei<li>drei</ul><pre><code>a &lt; b\n  c</code></pre><p>Formel $x^2$ hier.</p>"
    _, clean, parts = markup.convert(text)
    assert parts == [("heading", "Aufgaben"), ("item", "eins & zwei"), ("item", "drei"), ("code", "a < b\n  c"), ("text", "Formel $x^2$ hier.")]
    assert clean == "Aufgaben\n\n- eins & zwei\n- drei\n\n    a < b\n      c\n\nFormel $x^2$ hier."


def test_boilerplate_and_headings():
    nav = "\n".join(f'<a href="/x{i}">Seite {i}</a>' for i in range(5))
    body = "Wir suchen eine Person, die gerne kocht und im Team arbeitet.\n\nIhre Aufgaben:\nKochen\n"
    kinds = [k for k, _ in markup.convert(nav + "\n" + body)[2]]
    assert kinds[:5] == ["boilerplate"] * 5 and kinds[5:7] == ["text", "heading"]


# Texts that the tree hasn't seen.
HELD_OUT = (
    """
B [Home](/) [Stellenmarkt](/s) [Ratgeber](/r)
H Über uns
T Die Gärtnerei am Hang liefert seit drei Generationen Pflanzen und Kräuter in die ganze Stadt.
H Deine Aufgaben:
L - Pflanzen giessen und umtopfen
L - Kundschaft beraten
H Dein Profil
L Freude an der Arbeit im Freien
L Sicheres Auftreten im Verkauf
L Fahrausweis der Kategorie B
T Wir bieten ein Team, das zusammenhält, und einen Arbeitsplatz mit Aussicht.
B [AGB](/a) [Datenschutz](/d) [Medien](/m)
""",
    """
T Das Beispiel rechnet die Stunden eines Monats zusammen.
C hours = [];
C while (row = next()) { hours.push(row[2]); }
T Am Ende wird die Summe gerundet und im Bericht ausgegeben.
H Résumé
T Le programme est court, mais il suffit pour une petite équipe.
""",
    """
H What you will do
L - Answer calls
L - Write offers
H Your skills:
L - Two years in sales
T We look forward to your application and will reply within ten days.
B [More jobs](/x) [Imprint](/y)
""",
)


def test_tree_on_held_out_texts():
    tree = markup.block_tree()
    for texts, least in ((markup.LABELLED_TEXTS, 0.9), (HELD_OUT, 0.85)):
        found, labels = markup.labelled_blocks(texts)
        right = sum(tree.predict_one(r) == k for r, k in zip(found, labels))
        assert right >= least * len(labels), f"{right} of {len(labels)}"


def test_code_without_delimiters_is_no_markup():
    text = "Das Beispiel rechnet die Stunden zusammen.\ncall(a, **kw**);\nif (n > 10) { send(**kw**); }\nAm Ende wird die Summe im Bericht ausgegeben."
    assert markup.lex(text).families == {"markdown"}
    families, clean, parts = markup.convert(text)
    assert families == [] and ("code", "if (n > 10) { send(**kw**); }") in parts and "call(a, **kw**);" in clean
    assert markup.convert("Ein **fetter** Satz steht hier.\n" + text)[0] == ["markdown"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Pensum 80% ab sofort, Eintritt nach Vereinbarung. \\textbf{Aufgaben}\nSie arbeiten 100% im Team.", "Pensum 80% ab sofort, Eintritt nach Vereinbarung. Aufgaben Sie arbeiten 100% im Team."),
        ("\\emph{a} 80 % oder 100 %, [optional] mehr", "a 80 % oder 100 %, [optional] mehr"),
        ("% Entwurf\n\\section{Titel}\nText", "Titel Text"),
        ("\\a{\\b{\\c{\\d{\\e{\\f{\\g{tief}}}}}}}", "tief"),
        ("{{Hinweis|Uriga}} {{A|b={{C|drin}}|zwei}}", "Uriga drin zwei"),
        ("{{Leer}} Rest", "Rest"),
    ],
)
def test_words_outside_markup_survive(text, want):
    assert markup.convert(text)[1].split() == want.split()


SHAPES = ["**{}**", "<b>{}</b>", "\\textbf{{{}}}", "[[{}]]", "{{{{x|{}}}}}", "# {}", "- {}", "{} 80%", "\\section{{{}}}", "''{}''", "> {}", "<li>{}</li>", "{}"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SHAPES), st.integers(0, 10**6)), max_size=12))
def test_no_word_is_lost(parts):
    """Every word that stands in or beside any mixture of notations is in the clean text."""
    text = "\n".join(shape.format(f"wort{n} ende{n}") for shape, n in parts)
    clean = " ".join(t for _, t in markup.convert(text)[2])
    for _, n in parts:
        assert f"wort{n}" in clean and f"ende{n}" in clean
    assert clean.count("80%") == sum("80%" in shape for shape, _ in parts)


def test_long_text_is_whole():
    text = "<p>Wort **fett** " * 60_000 + "$x^2$"
    families, clean, _ = markup.convert(text)
    assert families == ["html", "markdown", "latex"] and clean.count("fett") == 60_000


def test_frames(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "a"), (1, "<b>x</b>", "a"), (2, None, "b"), (3, "", "c"), (None, "**x** $x^2$", "d")], "k long, t string, family string")
    found = markup.markup_families(df, key=["k"], text="t")
    assert sorted(map(str, rows(found.where("k IS NOT NULL")))) == ["(1, 'html')", "(1, 'html')"]
    assert found.where("k IS NULL").count() == 2
    done = {r.k: (r.families, r.clean_text) for r in markup.clean_texts(df, key=["k"], text="t").collect()}
    assert done[2] == ([], None) and done[3] == ([], "") and done[1] == (["html"], "x")
    assert markup.markup_families(df.limit(0), key=["k"], text="t").count() == 0
