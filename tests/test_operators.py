from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators import company, dedup, delivery, fuzzy, ranking, requirements, store, terms
from gleaner.operators.lookup import geocode
from tests.conftest import rows


def test_fuzzy():
    assert fuzzy.indel_ratio("", "") == 1 and fuzzy.indel_ratio("abc", "") == 0
    assert fuzzy.token_sort_ratio("koch bern", "bern koch") == 1
    assert fuzzy.token_set_ratio("vat", "vat gruppe") == 1 and fuzzy.token_set_ratio("", "x") == 0
    assert abs(fuzzy.indel_ratio("kitten", "sitting") - 8 / 13) < 1e-9


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_fuzzy_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert abs(fuzzy.indel_ratio(a, b) - 2 * brute_lcs(a, b) / (len(a) + len(b))) < 1e-12


JOBS = "id long, portal string, source_id string, title string, company_name string, city string, postal_code string, description_md string, apply_url string"


def test_cross_portal(spark):
    data = [
        (1, "job_room", "a", "Projektleiter Bau 100%", "Muster AG", "Bern", "3000", "x", None),
        (2, "ostjob", "b", "Projektleiter Bau (m/w/d)", "Muster Gruppe AG", "Bern", "3000", "x", None),
        (3, "myjob", "c", "Koch", "Anders AG", "Bern", "3000", "x", "https://www.a.example/1"),
        (4, "zentraljob", "d", "Küchenchef", "Ganz anders", "Bern", "3000", "x", "https://a.example/1/?utm=2"),
        (5, "myjob", "e", "Koch", "Anders AG", None, None, "x", None),
        (6, "myjob", "f", "Koch", "Anders AG", None, "", "x", None),
    ]
    got = dict(rows(dedup.cross_portal_clusters(spark.createDataFrame(data, JOBS))))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert dedup.cross_portal_clusters(spark.createDataFrame([], JOBS)).count() == 0


def test_cross_portal_at_any_size(spark):
    import random

    rng = random.Random(8)
    titles = ["Projektleiter Bau", "Projektleiterin Bau", "Bau Projektleiter", "Projektleiter Hochbau", "Koch", "Köche", "Kochen", "Sachbearbeiter Verkauf Innendienst", "Sachbearbeiterin Verkauf Innendienst", "Sachbearbeiter Einkauf Innendienst", "", "X", "IT", "ICT"]
    names = ["Muster AG", "Muster Bau AG", "Muster Bau Gruppe", "Mustermann", "Anders AG", "Anderes", None]
    data = [(i, rng.choice(["job_room", "ostjob", "myjob"]), str(i), rng.choice(titles), rng.choice(names), rng.choice(["Bern", "Thun", None]), rng.choice(["3000", "3000", "3001"]), "x", None) for i in range(400)]
    df = spark.createDataFrame(data, JOBS)
    whole = rows(dedup.cross_portal_clusters(df))
    assert len(whole) == 400 and sum(i != h for i, h in whole) > 100
    assert rows(dedup.cross_portal_clusters(df, max_group=1)) == whole
    two = spark.createDataFrame([(i, "myjob", str(i), "Koch", c, "Bern", "3000", "x", None) for i, c in ((1, "Muster"), (2, "Muster Bau"))], JOBS)
    assert rows(dedup.cross_portal_clusters(two, max_group=1)) == [(1, 1), (2, 1)]


def test_similar_titles_lose_no_pair(spark):
    import random

    rng = random.Random(9)
    titles = {"", "a", "b"}
    while len(titles) < 250:
        t = list(rng.choice(sorted(titles)[:30]) if rng.random() < 0.8 else "".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))))
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice("abcde"))
        titles.add("".join(t))
    want = sorted(("p", a, b) for a in titles for b in titles if fuzzy.token_sort_ratio(a, b) >= 0.88)
    assert len(want) > 400
    assert rows(dedup.similar_titles(spark.createDataFrame([("p", t) for t in titles], "block string, t string"), 0.88)) == want


def test_groups_and_stats(spark):
    data = [(i, p, s, "Koch 100%", "Muster AG", c, None, f"text {i}", None) for i, p, s, c in [(1, "ostjob", "9", "Bern"), (2, "job_room", "5", "Thun"), (3, "job_room", "4", "Biel")]]
    g = dedup.exact_groups(spark.createDataFrame(data, JOBS))
    assert sorted((r.id, r.group_size, r.is_group_representative) for r in g.collect()) == [(1, 3, False), (2, 3, False), (3, 3, True)]
    s = dedup.dedup_stats(g).first()
    assert (s.before, s.after, s.removed, s.biggest_group, s.reduction_pct) == (3, 1, 2, 3, 66.7)


def test_near_merges_against_greedy(spark):
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(60)] for _ in range(6)]
    data = []
    for i in range(80):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(60)] = f"neu{i}{rng.random()}"
        data.append((i, f"c{i % 2}", " ".join(words)))
    data += [(900, "c0", ""), (901, "c0", None)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, _, t in data if t}
    kept, want = {}, []
    for i, c, t in sorted(data):
        if not t:
            continue
        hit = next((h for h in kept.setdefault(c, []) if len(sets[i] & sets[h]) / len(sets[i] | sets[h]) >= 0.85), None)
        want.append((i, hit)) if hit is not None else kept[c].append(i)
    assert rows(dedup.near_merges(spark.createDataFrame(data, "id long, company_key string, description_md string"))) == sorted(want)


def test_geocode(spark):
    places = spark.createDataFrame([("3000", "Bern", "BE", 46.9, 7.4), ("3000", "Wabern", "BE", 46.8, 7.5), ("4000", "Basel", None, 47.5, 7.6)], "postal_code string, city string, canton string, lat double, lon double")
    jobs = spark.createDataFrame([(1, "3000", "WABERN", None, None, None), (2, "3000", "X", None, None, None), (3, None, "basel", "BS", None, None), (4, "3000", "Bern", None, 1.0, 2.0), (5, None, None, None, None, None)], "id long, postal_code string, city string, canton string, lat double, lon double")
    got = {r.id: (r.canton, r.lat, r.lon, r.geo_tier) for r in geocode(jobs, places).collect()}
    assert got == {1: ("BE", 46.8, 7.5, 1), 2: ("BE", 46.9, 7.4, 2), 3: ("BS", 47.5, 7.6, 3), 4: ("BE", 1.0, 2.0, None), 5: (None, None, None, None)}


@pytest.mark.parametrize("ads,codes,cities,mentions,want", [(32, 20, 17, 5, True), (19, 15, 6, 5, False), (32, 20, 17, 0, False), (32, 5, 17, 5, False)])
def test_agency_pattern(spark, ads, codes, cities, mentions, want):
    row = spark.createDataFrame([("x", "Firma", ads, False, mentions, codes, cities, codes / ads, 3.0)], "company_key string, name string, ads long, declared_agency boolean, client_mentions long, codes long, cities long, code_ratio double, spread_km double")
    assert company.verdicts(row).first().is_agency is want


def test_rank_spread(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 9.0), ("b", 4, 1.0), ("a", 5, None)], "p string, id long, v double")
    got = {r.id: r.spread for r in ranking.rank_spread(df, ["p"], "v", "id").collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0, 4: 1.0, 5: None}
    many = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    assert all(abs(r.spread - r.v / 999) < 1e-12 for r in ranking.rank_spread_distributed(many, "v", "id").collect())


def test_scores(spark):
    df = spark.createDataFrame([(None, None), (80, 80), (60, 70), (None, 30)], "lo int, hi int")
    assert [round(r[0], 4) for r in df.select(ranking.interval_fit(F.col("lo"), F.col("hi"), 80, 100, 30.0)).collect()] == [0.5, 1.0, 0.2, 0.0]
    assert spark.range(1).select(ranking.weighted_score({"a": (0.0, F.lit(1.0))}, {})).first()[0] is None


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", "alt", 1), ("a", "2", "bleibt", 2)], "p string, s string, t string, first int")
    new = spark.createDataFrame([("a", "1", "neu", 9), ("b", "1", "frisch", 9)], "p string, s string, t string, first int")
    once = store.upsert(old, new, ["p", "s"], ["t"])
    assert rows(once) == [("a", "1", "neu", 1), ("a", "2", "bleibt", 2), ("b", "1", "frisch", 9)]
    assert rows(store.upsert(once, new, ["p", "s"], ["t"])) == rows(once)
    assert tuple(store.upsert_counts(old, new, ["p", "s"]).first()) == (1, 1)
    assert rows(store.upsert(old.limit(0), new, ["p", "s"], ["t"])) == rows(new)


def test_seen_set_and_commit(spark, tmp_path):
    seen = spark.createDataFrame([("a", "1", "x")], "portal string, source_id string, url string")
    new = spark.createDataFrame([("a", "1", "y"), ("a", "2", "y"), ("a", "2", "y")], "portal string, source_id string, url string")
    after = store.record_entries(seen, new, ["portal", "source_id"])
    assert rows(after) == [("a", "1", "x"), ("a", "2", "y")]
    path = str(tmp_path / "t")
    store.commit(spark, after, path)
    store.commit(spark, store.record_entries(store.read(spark, path), new, ["portal", "source_id"]), path)
    assert rows(store.read(spark, path)) == rows(after)


def _boxes(table):
    return {b: f for b, f in table.state()["buckets"].items()}


def test_updates_touch_their_buckets_only_and_once(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    assert not table.exists()
    merge = lambda old, new: store.upsert(old, new, ["k"], ["v"])
    make = lambda data: spark.createDataFrame(data, "k string, v string")
    assert table.update(make([(f"k{i}", "a") for i in range(100)]), ["k"], merge, n_buckets=8, writer="w", batch=0)
    before = _boxes(table)
    assert table.update(make([("k3", "b"), ("neu", "c")]), ["k"], merge, writer="w", batch=1)
    after = _boxes(table)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and len(before) == 8
    got = dict(rows(table.read()))
    assert len(got) == 101 and got["k3"] == "b" and got["neu"] == "c" and got["k4"] == "a"
    # the same batch again, as after a crash
    assert not table.update(make([("k3", "z")]), ["k"], merge, writer="w", batch=1) and dict(rows(table.read()))["k3"] == "b"
    assert table.vacuum(keep=1) >= 0 and dict(rows(table.read())) == got


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = store.Table(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    merge = lambda old, new: store.upsert(old, new, ["k"], ["v"])
    table.update(df, ["k"], merge)
    with monkeypatch.context() as m:
        m.setattr(store.Table, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.update(df.selectExpr("k", "'2' AS v"), ["k"], merge, writer="w", batch=7)
    assert rows(table.read()) == [("a", "1")]
    assert table.update(df.selectExpr("k", "'2' AS v"), ["k"], merge, writer="w", batch=7) and rows(table.read()) == [("a", "2")]
    # two writers with one version: the second fails, nothing is overwritten
    state = table.state()
    with pytest.raises(RuntimeError, match="someone else"):
        table._publish(state)
    assert rows(table.read()) == [("a", "2")]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-5, 6, (300, 8)).astype(float)
    v[7] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)], "r_id long, r_v array<double>").withColumn("extra", F.lit("e"))
    asked = df.where("r_id % 3 = 0").select(F.col("r_id").alias("p_id"), F.col("r_v").alias("v"))
    for block in (2048, 17):
        got = {}
        for r in terms.nearest(asked, df, 5, block=block).collect():
            got.setdefault(r.p_id, {})[r.position] = r.r_id
            assert r.extra == "e"
        for i in range(0, 300, 3):
            want = sorted(range(300), key=lambda j: (-float(v[i] @ v[j]), j))[:5]
            assert [got[i][k] for k in range(1, 6)] == want
    assert terms.nearest(asked.limit(0), df, 5).count() == 0 and terms.nearest(asked, df.limit(0), 5).count() == 0


class _Fake:
    name, dim = "fake", 2
    known = {"Logistiker/in EFZ": [1.0, 0.0], "Lagerist/in": [0.99, 0.1], "Disponent/in": [0.98, 0.15], "Koch/Köchin EFZ": [0.0, 1.0], "Informatiker/in EFZ": [-1.0, 0.0]}

    def embed(self, texts):
        out = np.array([self.known.get(t, [1.0, 0.05]) for t in texts], np.float32)
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_labels_of_clusters(spark):
    fields = {"Logistiker/in EFZ": "Logistik", "Lagerist/in": "Logistik", "Disponent/in": "Logistik", "Koch/Köchin EFZ": "Gastgewerbe", "Informatiker/in EFZ": "Informatik"}
    taxonomy = spark.createDataFrame(list(fields.items()), "title string, field string")
    titles = spark.createDataFrame([(0, "logistiker"), (0, "lagerist"), (None, "x"), (1, None)], "cluster int, title string")
    (row,) = terms.label_clusters(titles, taxonomy, _Fake()).collect()
    assert (row.cluster, row.field, row.agreement, row.best) == (0, "Logistik", 0.6, "Logistiker/in EFZ")
    assert terms.label_clusters(titles, taxonomy, _Fake(), share=0.7).count() == 0 and terms.label_clusters(titles, taxonomy.limit(0), _Fake()).count() == 0
    df = spark.createDataFrame([(7, "Logistik", ["a", "b", "c", "d"]), (7, "Logistik", []), (7, None, ["a"]), (7, None, None)], "c int, f string, w array<string>")
    assert [r[0] for r in df.select(terms.cluster_name(F.col("c"), F.col("f"), F.col("w"))).collect()] == ["Logistik — a, b, c", "Logistik", "a", "Cluster 7"]
    report = terms.cluster_report(spark.createDataFrame([(0,), (0,), (1,), (-1,)], "label int")).first()
    assert tuple(report) == (2, 1, 4, 25.0) and terms.cluster_report(spark.createDataFrame([], "label int")).first()["noise_share"] == 0.0


def test_digest_state(spark, tmp_path):
    when = lambda d: F.lit(f"2025-01-0{d} 08:00:00").cast("timestamp")
    entries = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("q", 3, True)], "profile string, job_rowid long, is_new boolean")
    seen, runs = delivery.record_digest(entries, when(1))
    _, later = delivery.record_digest(entries.where("profile = 'p'"), when(2))
    runs = delivery.with_digest_path(runs.unionByName(later), spark.createDataFrame([("p", "x.md")], "profile string, path string"))
    assert {(r.profile, r.created_at.day, r.path) for r in runs.collect()} == {("p", 1, None), ("p", 2, "x.md"), ("q", 1, None)}
    assert {(r.profile, r.shown, r.new_count) for r in delivery.last_digest(runs).collect()} == {("p", 2, 1), ("q", 1, 1)}
    assert rows(delivery.digest_stats(runs, seen)) == [("p", 2, 2), ("q", 1, 1)]
    path = delivery.write_digest([{"position": 1, "title": "T", "company_name": "A", "workload": "80%", "is_new": True, "snippet": "s"}], "p/x", str(tmp_path), when=datetime(2025, 1, 2))
    assert path.endswith("2025-01-02_p_x.md") and "**T**" in open(path, encoding="utf-8").read()
    profiles = spark.createDataFrame([("b",), ("a",), ("q",)], "profile string")
    assert [r.profile for r in delivery.profiles_by_scores(profiles, entries).collect()] == ["q", "a", "b"]


def test_places_by_first_occurrence(spark):
    df = spark.createDataFrame([("g", "Bern", 3), ("g", "Aarau", 5), ("g", "Bern", 9), ("g", "Zug", 1), ("g", "", 0), (None, "Chur", 1)], "group_id string, city string, id long")
    assert delivery.group_places(df, order="id").first()["places"] == ["Zug", "Bern", "Aarau"] and delivery.group_places(df).first()["places"] == ["Aarau", "Bern", "Zug"]


def test_stand_in_codes_are_no_place(spark):
    data = [(1, "job_room", "Koch", "Sonne", "Chur", "k.A.", "x", None), (2, "myjob", "Koch", "Sonne", "Genf", "k.A.", "x", None), (3, "myjob", "Koch", "Sonne", "Chur", "0000", "x", None)]
    df = spark.createDataFrame(data, "id long, portal string, title string, company_name string, city string, postal_code string, description_md string, apply_url string")
    got = dict(rows(dedup.cross_portal_clusters(df)))
    assert got[1] == got[3] and got[1] != got[2]
    assert rows(dedup.cross_portal_clusters(df, max_group=1)) == rows(dedup.cross_portal_clusters(df))


def test_digest_and_render(spark):
    scores = spark.createDataFrame([("p", i, 1.0 - i / 10) for i in range(6)], "profile string, job_rowid long, final_score double")
    jobs = spark.createDataFrame([(i, "A" if i < 4 else "B", f"<b>T{i}</b>", 80, 100, "x", None) for i in range(6)], "id long, company_name string, title string, workload_min int, workload_max int, description_md string, group_id string")
    seen = spark.createDataFrame([("p", 0)], "profile string, job_rowid long")
    got = [(r.job_rowid, r.is_new, r.position) for r in delivery.digest(scores, jobs, seen, top=4, cap=2).orderBy("position").collect()]
    assert got == [(0, False, 1), (1, True, 2), (4, True, 3), (5, True, 4)]
    listed = [r.asDict() for r in delivery.digest(scores, jobs, seen, top=2, cap=2).orderBy("position").collect()]
    assert "&lt;b&gt;T0" in delivery.render(listed, "p", fmt="html", when=datetime(2025, 1, 1)) and "01.01.2025" in delivery.render(listed, "p", when=datetime(2025, 1, 1))


def test_requirements(spark):
    body = "<ul><li>Mindestens zwei Jahre Berufserfahrung</li><li>Englisch zwingend erforderlich, Französisch von Vorteil</li><li>Abschluss HF von Vorteil</li></ul>"
    df = spark.createDataFrame([("Abteilungsleiter", body), ("Junior Manager", None)], "t string, d string")
    a, b = (r[0] for r in df.select(requirements.requirements(F.col("t"), F.col("d"))).collect())
    assert a.is_leadership and not a.is_senior and a.education == "hf" and a.education_is_soft and a.years == 2 and a.languages == {"fr": 0.0, "en": 1.0}
    assert not b.is_senior and b.education == "keine" and b.years is None and b.languages == {}


def test_skills_and_terms(spark):
    df = spark.createDataFrame([("Node.js und C++",), ("node.jsx",), (None,)], "t string")
    skills = {"Node": ["Node.js"], "C++": []}
    assert [r[0] for r in df.select(terms.skills_found(F.col("t"), skills)).collect()] == [["Node", "C++"], [], []]
    docs = spark.createDataFrame([("a", "gärtner pflanzen")] * 4 + [("b", "koch küche")] * 4 + [(None, "gärtner")], "g string, t string")
    found = terms.characteristic_terms(docs, group="g", text="t")
    assert {(r.g, r.term) for r in found.collect()} == {("a", "gärtner"), ("a", "pflanzen"), ("b", "koch"), ("b", "küche")}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    best, at = vectors.cosine_max(F.col("v"), [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    assert [tuple(r) for r in df.select(best, at).collect()] == [(4.0, 1), (0.0, 0)]
    e = vectors.HashingEmbedder(32)
    v = spark.createDataFrame([("Koch in Bern",), ("Koch in Bern",), (None,)], "t string").select(vectors.embed_udf(e)("t")).collect()
    assert v[0][0] == v[1][0] and abs(sum(x * x for x in v[0][0]) - 1) < 1e-5


def test_table_maintenance(spark, tmp_path):
    from pyspark.sql import types as T

    seen = spark.createDataFrame([("a", "9", None, None, None), ("a", "10", None, None, None), ("a", "x", None, None, None), ("a", "1", "2025", 200, "p")], "portal string, source_id string, fetched_at string, http_status int, raw_path string")
    assert [r.source_id for r in store.pending(seen, 2).collect()] == ["10", "9"]
    results = spark.createDataFrame([("a", "9", "2026", 410, None), ("b", "7", "2026", 200, "q")], seen.schema)
    done = {(r.portal, r.source_id): r.http_status for r in store.mark_fetched(seen, results, ["portal", "source_id"]).collect()}
    assert done == {("a", "9"): 410, ("a", "10"): None, ("a", "x"): None, ("a", "1"): 200}
    path = str(tmp_path / "scores")
    store.replace_partition(spark.createDataFrame([(1, "p"), (2, "q")], "x int, profile string"), path, "profile")
    store.replace_partition(spark.createDataFrame([(9, "p")], "x int, profile string"), path, "profile")
    assert sorted((r.x, r.profile) for r in spark.read.parquet(path).collect()) == [(2, "q"), (9, "p")]
    now = T.StructType([T.StructField("x", T.LongType()), T.StructField("neu", T.StringType())])
    assert rows(store.conform(spark.createDataFrame([(1, "weg")], "x int, old string"), now)) == [(1, None)]
    log = store.run_log(spark, "job_room", "ok", items_seen=3, items_new=1).first()
    assert (log.source, log.status, log.items_seen, log.items_new) == ("job_room", "ok", 3, 1) and log.finished_at is not None
    expired = spark.createDataFrame([("active", "2025-01-01"), ("active", None), ("expired", "2030-01-01")], "status string, expires_at string")
    assert [r.status for r in store.mark_expired(expired, F.lit("2025-06-01")).collect()] == ["expired", "active", "expired"]


def test_grouped_functions_come_whole(spark):
    from gleaner.operators.grouped import map_groups

    df = spark.range(5000).select((F.col("id") % 7).alias("k"), "id", F.when(F.col("id") % 7 == 3, F.lit("hot")).otherwise("cold").alias("x"))
    f = lambda g: g.iloc[[0]].assign(n=len(g), ok=bool((g["id"].diff().dropna() > 0).all()))[["k", "n", "ok"]]
    got = rows(map_groups(df, ["k"], ["id"], f, "k long, n long, ok boolean"))
    assert got == [(k, 5000 // 7 + (k < 5000 % 7), True) for k in range(7)]
    assert map_groups(df.limit(0), ["k"], ["id"], f, "k long, n long, ok boolean").count() == 0


def test_number_of_clusters_grows_with_the_rows(spark):
    import random

    rng = random.Random(5)
    centres = [[rng.uniform(-10, 10) for _ in range(6)] for _ in range(80)]
    data = [(i, [x + rng.gauss(0, 0.01) for x in centres[i % 80]]) for i in range(2400)]
    got = dict(rows(terms.vector_clusters(spark.createDataFrame(data, "id long, v array<double>"), key="id", vector="v", min_size=6, dims=6)))
    assert len(got) == 2400 and len(set(got.values()) - {-1}) > 64


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    from gleaner.session import fits_broadcast

    df = spark.range(100).withColumn("t", F.lit("x" * 1000))
    assert fits_broadcast(df) and not fits_broadcast(df, rows=99) and not fits_broadcast(df, size=50_000)
    assert fits_broadcast(df.limit(0)) and fits_broadcast(df.withColumn("n", F.lit(None).cast("string")))


def test_no_local_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from gleaner.session import ensure_checkpoint_dir

    def session(master, set_to=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: set_to))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master))
        assert ensure_checkpoint_dir(session(master, "/shared")) == "/shared"
