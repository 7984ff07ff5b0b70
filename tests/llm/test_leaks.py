import random

from gleaner.llm import leaks as L
from tests.conftest import rows


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [L.normalise(t).split()] for i in range(len(w) - n + 1)}
    known = {i: grams(t) for i, t in items if t}
    return sorted((d, i) for d, t in docs if t for i, g in known.items() if g & grams(t))


def data():
    rng = random.Random(6)
    words = [f"wort{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "zu kurz")]
    docs = []
    for d in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if d % 2:
            w = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(w))
            text[len(text) // 2 : len(text) // 2] = w[a : a + rng.choice([5, 11, 12, 13, 40])]
        docs.append((d, " ".join(text)))
    return docs + [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def test_against_brute_force(spark):
    docs, items = data()
    for blocks in (20_000, 7):
        found = L.leaks(*frames(spark, docs, items), max_items=blocks)
        assert rows(L.leaked_pairs(found)) == sorted(set(brute(docs, items, 12)))


def test_offsets_and_disguises():
    item = "Die Kommission bewertet die Akte 118, ob Überzeit mit (Maro-489) Freizeit gleicher Dauer abgegolten wird."
    scanner = L.LeakScanner([(7, item)])
    disguised = "Vorher. DIE  KOMMISSION\nbewertet – die Akte 118; ob U\u0308berzeit mit Maro 489 Frei\u00adzeit glei\u200bcher Dauer abgegolten?! Nachher."
    (run,) = scanner.scan(disguised)
    assert run[0] == 7 and disguised[run[1] : run[2]].startswith("DIE") and disguised[run[1] : run[2]].endswith("abgegolten") and run[3] == 15
    assert scanner.scan("Die Kommission bewertet die Akte 118, ob Überzeit mit Maro 488 Freizeit gleicher Dauer") == []


def test_long_text_and_empty(spark):
    docs, items = data()
    long = "leer " * 200_000 + next(t for i, t in items if t and len(t.split()) > 20)
    (run,) = L.LeakScanner([(i, t) for i, t in items if t]).scan(long)
    assert long[run[1] : run[2]] in long and run[1] >= 1_000_000 - 5
    d, i = frames(spark, docs, items)
    assert L.leaks(d, i.limit(0)).count() == 0 and L.leaks(d.limit(0), i).count() == 0


def test_scan_is_linear():
    import time

    words = [f"w{i % 997}x{i}" for i in range(24_000)]
    took = []
    for n in (6_000, 24_000):
        scanner = L.LeakScanner([(1, " ".join(words[:n]))])
        text = " ".join(words[:n])
        began = time.perf_counter()
        (run,) = scanner.scan(text)
        took.append(time.perf_counter() - began)
        assert run == (1, 0, len(text), n)
    assert took[1] < 12 * took[0]


def test_query_beside_sql(spark, sf_dir):
    from tests.compare import differences

    assert differences(spark, sf_dir, "p9_found", L.p9_found, L.P9_FOUND_SQL) is None
