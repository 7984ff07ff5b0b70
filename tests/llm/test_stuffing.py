import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import stuffing as S
from tests.conftest import rows

PROSE = "Die Firmen in der Region suchen seit dem Frühling neue Leute, und viele von ihnen bezahlen heute bessere Löhne als im letzten Jahr. Wer sich für eine Stelle interessiert, sollte vor dem ersten Gespräch mit den Kollegen sprechen. "


def stuffed():
    rng = random.Random(3)
    jobs = ["Koch", "Maurer", "Gärtner", "Bäcker", "Laborant"]
    pick = lambda: rng.choice(jobs)
    return {
        "repeated": " ".join(rng.choice(["Job", "Lohn", "Stelle", "günstig"]) for _ in range(80)),
        "tags": " ".join(f"#{pick().lower()}{rng.randint(0, 30)}" for _ in range(60)),
        "pipes": " | ".join(rng.choice([*jobs, "Bern", "Thun", "Lohn"]) for _ in range(60)),
        "links": "\n".join(f"- [{pick()} Lohn](https://a{i}.example/{i})" for i in range(25)),
        "catalogue": "\n".join(f"Helm rot Art. {rng.randint(10000, 99999)} {pick()} Lohn" for _ in range(15)),
        "doorway": " ".join(f"Koch Lohn Ort{i} Koch Stelle in Dorf{i} Lohn." for i in range(15)),
    }


@pytest.mark.parametrize("kind", sorted(stuffed()))
def test_kinds(kind):
    text = stuffed()[kind]
    assert S.stuffed_share(text) > 0.8
    assert S.stuffed_share(PROSE + "\n\n" + text) > 0.4


@pytest.mark.parametrize("text", [PROSE, PROSE * 5 + "\nTags: Koch, Maurer, Bern, Lohn", "- Komplexe Pläne für die Abteilung prüfen\n- Berichte nach Vorgabe der Leitung erstellen\n- Offerten und Verträge vorbereiten\n" * 4, PROSE * 4 + " https://a.example/1", "", "   ", "1 2 3"])
def test_no_cases(text):
    assert S.stuffed_share(text) <= 0.5


def test_whole_operator(spark):
    pages = [(i, PROSE * (1 + i % 5)) for i in range(60)] + [(100 + k, t) for k, t in enumerate(stuffed().values())] + [(200, None), (201, ""), (202, " "), (203, "Koch " * 30_000), (203, "Koch " * 30_000), (None, "Koch " * 90)]
    df = spark.createDataFrame([(i, t, "x") for i, t in pages], "doc_id long, text string, stuffed_share string")
    assert sorted(r.doc_id for r in S.stuffed_pages(df).select("doc_id").distinct().collect()) == [*range(100, 106), 203]
    assert S.stuffed_pages(df.limit(0)).count() == 0


def test_curves_lose_nothing(spark, sf_dir):
    """What the exact reading finds among all pages is flagged by its curve."""
    pages = S._pages(spark, sf_dir)
    profiles = S.cut(S.page_profiles(pages))
    odds = S.corpus_odds(profiles, S.scored(S.rank_frequency(profiles)).where("flagged").select("doc_id", "h"))
    exact = sorted((r.doc_id,) for r in pages.collect() if r.text and S.stuffed_share(r.text, odds) > 0.5)
    assert rows(S.p10_found(spark, sf_dir)) == exact


def test_curve_is_the_fit_over_all_ranks(spark):
    text = "und " * 40 + "der " * 20 + "koch " * 10 + "lohn " * 10 + " ".join(f"wort{i}" for i in range(12))
    got = S.rank_frequency(S.page_profiles(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))).collect()
    assert len(got) == 1 and got[0].n == 92 and got[0].lang == "de" and got[0].length_class == 6
    y = np.log(np.array([40, 20, 10, 10, *[1] * 12]))
    slope, _ = np.polyfit(np.log(np.arange(1, len(y) + 1)), y, 1)
    assert got[0].slope == pytest.approx(slope, abs=0.05)
    assert got[0].bands == pytest.approx([40 / 92, 20 / 92, 0, 0, 0, 0, 0, 0, 0, 10 / 92, 13 / 92, 8 / 92, 1 / 92, 0, 0, 0])


def test_divergence(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.7, 0.3], [0.4, 0.6])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(S.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    kl = lambda p, q: sum(x * math.log(x / y) for x, y in zip(p, q))
    m = (0.55, 0.45)
    assert got == pytest.approx([0.0, math.log(2), (kl((0.7, 0.3), m) + kl((0.4, 0.6), m)) / 2])


def test_rates_follow_the_corpus():
    assert (S.log_odds((0,) * 6, (0,) * 6) == S.log_odds()).all()
    assert S.log_odds((10**9, 1, 1, 1, 1, 1), (1, 10**9, 1, 1, 1, 1))[S.FUNCTION] > 0 > S.log_odds()[S.FUNCTION]


def test_links_outside_the_curve(spark):
    urls = [f"https://a{i}.example/{i}" for i in range(300)]
    pages = [(i, PROSE * (1 + i % 5)) for i in range(60)] + [(100, "\n".join(urls)), (101, PROSE * 3 + "\n" + "\n".join(urls)), (102, " ".join(urls)), (103, "<img src='a'>\n" * 50), (104, PROSE * 5 + urls[0]), (105, PROSE * 3 + "\n" + "\n".join(f"[und der Lohn]({u})" for u in urls)), (106, " ")]
    df = spark.createDataFrame(pages, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.stuffed_pages(df).collect()) == sorted(i for i, t in pages if S.stuffed_share(t) > 0.5) == [100, 101, 102, 105]
    curves = {r.doc_id: r for r in S.rank_frequency(S.page_profiles(df)).collect()}
    assert curves[100].n == 0 and curves[100].link_share == 1.0 and not {103, 106} & set(curves)
    assert curves[105].link_share == pytest.approx(900 / (900 + len(S._tokens(PROSE * 3)[0])))
