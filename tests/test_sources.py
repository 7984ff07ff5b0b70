import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.functions.vectors import HashingEmbedder
from gleaner.operators import store
from gleaner.plans import pipeline
from gleaner.sources import paged, raw, settings, web
from gleaner.streaming import increments
from tests.conftest import rows

def now():
    return F.lit("2025-09-01 00:00:00").cast("timestamp")


def record(i, **content):
    base = {
        "externalUrl": "https://x.example", "jobDescriptions": [{"languageIsoCode": "fr", "title": "Chef", "description": "Bonjour"}, {"languageIsoCode": "DE", "title": " Koch  100% ", "description": "Hallo"}],
        "company": {"name": "Muster AG", "surrogate": False}, "employment": {"permanent": True, "workloadPercentageMin": "80", "workloadPercentageMax": "100", "workForms": ["HOME_WORK"]},
        "location": {"city": "Bern", "postalCode": "3000", "cantonCode": "BE", "coordinates": {"lon": "7.4", "lat": "46.9"}},
        "occupations": [{"avamOccupationCode": "1"}, {"avamOccupationCode": ""}], "languageSkills": [], "applyChannelFlags": {"form_url": ""},
    }
    return {"id": i, "createdTime": "2025-01-02T03:04:05", "jobContent": base | content, "publication": {"startDate": "2025-01-01", "endDate": "2025-02-01"}}


@pytest.fixture
def raw_folder(tmp_path):
    for day, i, name in (("2025-01-01", "a", "Alt AG"), ("2025-01-02", "a", "Neu AG"), ("2025-01-02", "b", "Muster AG"), ("2025-01-02", "c", "")):
        os.makedirs(tmp_path / day, exist_ok=True)
        with gzip.open(tmp_path / day / f"{i}.json.gz", "wt") as f:
            json.dump(record(i, company={"name": name, "surrogate": False}), f)
    (tmp_path / "2025-01-02" / "d.json.gz").write_bytes(b"no gzip")
    with gzip.open(tmp_path / "2025-01-02" / "e.json.gz", "wt") as f:
        f.write('{"id": "e", ')
    return str(tmp_path)


def test_raw_files_to_canonical(spark, raw_folder):
    read = raw.read_files(spark, raw_folder, "job_room", raw.SCHEMAS["a"])
    assert read.count() == 4
    done = raw.last_path_wins(raw.project_a(read, now()))
    got = {r.source_id: r for r in done.collect()}
    assert sorted(got) == ["a", "b"] and got["a"].company_name == "Neu AG"
    b = got["b"]
    assert (b.title, b.description_md, b.workload_min, b.home_office, b.lat, b.status, b.apply_url, b.occupation_codes) == ("Koch 100%", "Hallo", 80, True, 46.9, "expired", "https://x.example", ["1"])
    assert rows(raw.locations(read)) == [("3000", "Bern", "BE", 46.9, 7.4)]


def test_parse_pipeline(spark, raw_folder):
    read = raw.read_files(spark, raw_folder, "job_room", raw.SCHEMAS["a"])
    places = raw.locations(read)
    done = pipeline.parse(raw.project_a(read, now()), places)
    got = {r.source_id: r for r in done.collect()}
    # two groups, but one application URL: only the head of the cluster represents it
    assert len(got) == 2 and all(r.group_size == 1 for r in got.values()) and sum(r.is_group_representative for r in got.values()) == 1
    assert got["a"].company_is_agency is False and got["a"].workload_from_title is False


def test_raw_cache_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("job_room", "2025-01-01", "a/../b", '{"x":1}')], "portal string, day string, source_id string, json string")
    raw.write_raw(df, str(tmp_path / "cache"))
    assert [(r.portal, r.source_id, r.json) for r in raw.read_raw(spark, str(tmp_path / "cache")).collect()] == [("job_room", "a___b", '{"x":1}')]


def test_sitemap(spark, tmp_path):
    xml = "<urlset><url><loc>https://a.example/job/koch/12</loc><lastmod>2025-01-01</lastmod></url><url><loc>https://a.example/about</loc></url><url><loc>https://a.example/job/x/13</loc><lastmod></lastmod></url></urlset>"
    (tmp_path / "s.xml").write_text(xml)
    want = [("12", True), ("13", False)]
    assert sorted((r.source_id, r.lastmod is not None) for r in web.read_sitemap(spark, str(tmp_path / "s.xml")).collect()) == want
    df = spark.createDataFrame([(xml,), ("",), (None,)], "xml string")
    assert sorted((r.source_id, r.lastmod is not None) for r in web.parse_sitemap(df).collect()) == want


def test_embedded_state(spark):
    page = lambda state: f"<title>x</title><script>window.__PRELOADED_STATE__ = {state};</script>"
    good = '{"a":"}\\"{","vacancyDetails":{"data":{"id":7}}}'
    data = [("1", 200, page(good)), ("2", 404, ""), ("3", 200, "<title>Nicht mehr verfügbar</title>"), ("4", 200, page('{"vacancyDetails":{"data":{}}}')), ("5", 200, page('{"x":')), ("6", 200, None)]
    done = {r.source_id: (r.outcome, r.http_status, r.vacancy) for r in web.route_fetches(spark.createDataFrame(data, "source_id string, http_status int, html string")).collect()}
    assert done == {"1": ("ok", 200, '{"id":7}'), "2": ("gone", 404, None), "3": ("gone", 410, None), "4": ("missing", 200, None), "5": ("missing", 200, None), "6": ("missing", 200, None)}


def test_settings(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("name: p\ntarget_roles: [{name: Koch}]\nlocations: [{label: B, lat: 46.9, lon: 7.4}]\nunknown: 1\n")
    (tmp_path / "q.yaml").write_text("name: q\nworkload_min: 90\nworkload_max: 50\n")
    p = settings.load_profile(str(tmp_path / "p.yaml"))
    assert p.locations[0].radius_km == 25.0 and settings.list_profiles(str(tmp_path)) == ["p", "q"]
    with pytest.raises(ValueError):
        settings.load_profile(str(tmp_path / "q.yaml"))
    (tmp_path / "skills.yml").write_text("web: [HTML, {JavaScript: [JS]}]\n")
    skills = settings.load_skills(str(tmp_path / "skills.yml"))
    assert skills == {"web": {"HTML": [], "JavaScript": ["JS"]}} and settings.skills_table(spark, skills).count() == 2


def test_taxonomy(spark, tmp_path):
    data = [{"job_id": "1", "title": "Koch", "categories": {"berufsfelder": ["Gastro", "x"]}, "taetigkeiten": {"kategorien": {"Kochen": ["a"]}}, "weiterbildung": {"career_progression": [{"level": "1", "type": "t", "options": ["o1", "o2"]}]}}, {"job_id": "", "title": "y"}]
    (tmp_path / "t.json").write_text(json.dumps(data))
    t = settings.read_taxonomy(spark, str(tmp_path / "t.json"))
    assert [(r.title, r.berufsfeld) for r in t.collect()] == [("Koch", "Gastro")]
    assert rows(settings.activity_vocabulary(t)) == [("Kochen", 1)] and rows(settings.career_hints(t, "koch")) == [("1", "t", "o1")]


def test_paged_source(spark, tmp_path):
    (tmp_path / "total.json").write_text('{"total": 3, "size": 2}')
    (tmp_path / "page-0.json").write_text('[{"id": 1, "canton": "BE"}, {"id": 2, "canton": "ZH"}]')
    (tmp_path / "page-1.json").write_text('[{"id": 3, "canton": "BE", "workload": 80, "title": "Koch", "permanent": true}]')
    spark.dataSource.register(paged.PagedSearch)
    df = spark.read.format("paged_search").load(str(tmp_path))
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3"] and sorted(r.id for r in df.where("canton = 'BE'").collect()) == ["1", "3"]
    for test in ("workload >= 60 AND workload < 90", "title LIKE '%oc%'", "permanent", "canton IN ('BE', 'GE') AND workload IS NOT NULL", "workload > 79 AND workload <= 80"):
        assert [r.id for r in df.where(test).collect()] == ["3"], test
    assert df.where("workload > 80").count() == 0 and paged.count_results(str(tmp_path)) == 3
    assert [r.canton for r in paged.fetch_one(spark, str(tmp_path), "2").collect()] == ["ZH"] and paged.fetch_one(spark, str(tmp_path), "9").count() == 0
    with pytest.raises(Exception, match="window holds"):
        spark.read.format("paged_search").option("window", "2").load(str(tmp_path)).collect()


def test_streams(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "seen", "state"))
    schema = "portal string, source_id string, url string"
    for data in ([("a", "1", "x"), ("a", "2", "x")], [("a", "2", "y"), ("a", "3", "y")]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = increments.file_stream(spark, source, schema, max_files=1)
        increments.keep_seen_set(stream, target, ["portal", "source_id"], state).awaitTermination()
    assert rows(store.read(spark, target)) == [("a", "1", "x"), ("a", "2", "x"), ("a", "3", "y")]
    stream = increments.file_stream(spark, source, schema)
    increments.keep_table(stream, str(tmp_path / "table"), ["portal", "source_id"], ["url"], str(tmp_path / "s2")).awaitTermination()
    assert {r[1] for r in rows(store.read(spark, str(tmp_path / "table")))} == {"1", "2", "3"}
    increments.keep_seen_set(stream.selectExpr("portal", "source_id", "url", "CAST(NULL AS timestamp) AS fetched_at"), str(tmp_path / "seed"), ["portal", "source_id"], str(tmp_path / "s3"), seed=True).awaitTermination()
    seeded = store.read(spark, str(tmp_path / "seed"))
    assert seeded.count() == 3 and store.pending(seeded).count() == 0 and seeded.where("url IS NOT NULL").count() == 0


def test_windowed_and_first_seen(spark, tmp_path):
    source = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2025-01-01 10:00:00' + make_interval(0,0,0,0,id,0,0) AS ts, CAST(id % 3 AS string) AS k FROM range(50)").coalesce(1).write.parquet(source)
    stream = increments.file_stream(spark, source, "ts timestamp, k string")
    for name, df in (("w", increments.windowed_counts(stream, "ts", "k")), ("f", increments.first_seen(stream, ["k"], "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("f").count() == 3 and spark.table("w").agg(F.sum("n")).first()[0] >= 24


def test_score_pipeline(spark):
    p = settings.Profile("p", target_roles=[{"name": "Koch"}, {"name": "Gärtner"}], locations=[{"label": "B", "lat": 46.9, "lon": 7.4}], keywords_positive=["küche"], keywords_exclude=["nacht"], occupation_prefixes=["1"], description_languages=["de"], wants_flextime=True)
    data = [(i, t, "Muster AG", d, 80, 100, 46.9, 7.4, False, None, "active", True, lang, codes) for i, t, d, lang, codes in [
        (1, "Koch", "Küche mit Gleitzeit", "de", ["12"]), (2, "Fahrer", "Nacht", None, ["13"]), (3, "Koch", "x", "fr", ["12"]), (4, "Koch", "x", "de", ["22"]), (5, "Koch", "x", "de", None)]]
    schema = "id long, title string, company_name string, description_md string, workload_min int, workload_max int, lat double, lon double, company_is_agency boolean, home_office boolean, status string, is_group_representative boolean, description_language string, occupation_codes array<string>"
    jobs = spark.createDataFrame(data, schema).withColumn("posted_at", now())
    done = {r.job_rowid: r for r in pipeline.score(jobs, p, now()).collect()}
    assert sorted(done) == [1, 2] and done[1].best_role == "Koch" and done[1].final_score > done[2].final_score
    assert done[1].scores["flextime"] == 1.0 and done[2].scores["exclude_penalty"] == 1.0 - 0.75 and "flextime" not in done[2].reasons
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    e = HashingEmbedder(16)
    first = pipeline.embed_texts(texts, None, e)
    cache = first.select("cache_key", "vector").distinct()
    assert cache.count() == 2 and pipeline.embed_texts(texts, cache, e).count() == 3
    assert store.unseen(first.select("cache_key", "vector"), cache, ["cache_key"]).count() == 0


def test_skipped_files_are_listed(spark, raw_folder):
    got = {(os.path.basename(r.raw_path), r.reason) for r in raw.skipped_files(spark, raw_folder, raw.SCHEMAS["a"]).collect()}
    assert got == {("d.json.gz", "unreadable"), ("e.json.gz", "broken")}
    assert store.cache_report(spark, raw_folder).first()["files"] == 6 and store.cache_report(spark, raw_folder).first()["days"] == 2


def test_source_b_keeps_what_the_source_says(spark):
    data = [{"id": i, "title": "Koch", "company": {"name": "A"}, "home_office": h, "url_application": None, "url_description": "https://b.example/1", "_source_url": "https://b.example/2"} for i, h in ((1, False), (2, True), (3, None))]
    df = spark.createDataFrame([(json.dumps(d),) for d in data], "j string").select(F.from_json("j", raw.SCHEMAS["b"]).alias("r")).select("r.*", F.lit("myjob").alias("portal"))
    got = {r.source_id: (r.home_office, r.apply_url) for r in raw.project_b(df, now()).collect()}
    assert got == {"1": (False, "https://b.example/1"), "2": (True, "https://b.example/1"), "3": (None, "https://b.example/1")}


def test_several_sitemaps(spark, tmp_path):
    for name, stamp in (("a.xml", "2025-01-01"), ("b.xml", "2025-02-01")):
        (tmp_path / name).write_text(f"<urlset><url><loc>https://m.example/job/koch/7</loc><lastmod>{stamp}</lastmod></url><url><loc>https://m.example/job/koch/{len(stamp)}{name[0] == 'a' and 1 or 2}</loc></url><url><loc>https://m.example/x</loc></url></urlset>")
    got = {r.source_id: r.lastmod for r in web.read_sitemaps(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")]).collect()}
    assert set(got) == {"7", "101", "102"} and got["7"].month == 2


def test_choice_of_embedder():
    from gleaner.functions.vectors import choose_embedder

    def broken():
        raise OSError("no model")

    said = []
    assert choose_embedder([broken, HashingEmbedder], said.append).name == "hashing-256" and "no model" in said[0]
    with pytest.raises(RuntimeError, match="no embedder"):
        choose_embedder([broken])


def test_runs_and_command_line(spark, raw_folder, tmp_path, capsys):
    from datetime import datetime

    from gleaner.__main__ import parser
    from gleaner.plans.runs import Runs

    home = str(tmp_path / "store")
    first = Runs(spark, home, now=datetime(2025, 1, 5)).parse(source_a=raw_folder)
    assert (first["new"], first["updated"], first["skipped"]) == (2, 0, 2)
    runs = Runs(spark, home, now=datetime(2025, 1, 6))
    again = runs.parse(source_a=raw_folder)
    assert (again["new"], again["updated"]) == (0, 2)
    jobs = {r.source_id: r for r in runs.table("jobs").read().collect()}
    assert jobs["a"].first_seen_at.day == 5 and jobs["a"].last_seen_at.day == 6
    profile = settings.Profile("p", target_roles=[{"name": "Koch"}], locations=[{"label": "B", "lat": 46.9, "lon": 7.4}])
    active = runs.table("jobs").read().withColumn("status", F.lit("active"))
    runs.table("jobs").replace(active, ["portal", "source_id"], n_buckets=4)
    assert runs.score(profile)["scored"] >= 1
    path = runs.digest("p", str(tmp_path / "out"))
    text = open(path, encoding="utf-8").read()
    assert "*neu*" in text and "*neu*" not in open(Runs(spark, home, now=datetime(2025, 1, 7)).digest("p", str(tmp_path / "out")), encoding="utf-8").read()
    runs.rate("p", jobs["a"].id, -1, "ort")
    runs.rate("p", jobs["a"].id, 1)
    assert [(r.rating, r.reason) for r in runs.table("feedback").read().collect()] == [(1, None)]
    with pytest.raises(ValueError):
        runs.rate("p", 1, 5)
    status = runs.status(raw_folder)
    assert status["jobs"] == 2 and status["feedback"] == 1 and status["digest_runs"] == 2 and {r["source"] for r in status["runs"]} == {"parse", "score", "digest"} and status["raw"]["days"] == 2
    assert runs.clusters().count() == 0
    args = parser().parse_args([home, "rate", "p", "7", "-1", "--reason", "ort"])
    assert (args.command, args.job, args.rating, args.reason) == ("rate", 7, -1, "ort")
