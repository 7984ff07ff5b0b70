"""Joins, aggregates, ranks, set operations and table maintenance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions import vectors
from gleaner.functions.geo import haversine_km
from gleaner.functions.pii import contact_leaks, scrub_source_b
from gleaner.operators import company, dedup, delivery, ranking, store, terms
from gleaner.operators.lookup import geocode
from gleaner.operators.spatial import points_in_regions, points_within
from gleaner.plans.text_queries import _company, _strip
from gleaner.session import table, texts
from gleaner.sources import raw, web

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2025-09-01 00:00:00"
ORDER = lambda: [F.col("final_score").desc(), F.col("job_rowid")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scores", "profile", "job_rowid", "final_score", "semantic_raw", "computed_at", "rules_json")
    return store.latest(rows, ["profile", "job_rowid"], "computed_at", "final_score")


LATEST = "(SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY profile, job_rowid ORDER BY computed_at DESC, final_score DESC) = 1)"


# --- lookups and profiles ------------------------------------------------------------------------
@query(
    """
WITH e AS (SELECT postal_code, lower(city) AS c, lat, lon, canton FROM plz_coords WHERE postal_code IS NOT NULL AND city IS NOT NULL QUALIFY row_number() OVER (PARTITION BY postal_code, lower(city) ORDER BY lat, lon) = 1),
     p AS (SELECT postal_code, lat, lon, canton FROM plz_coords WHERE postal_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY postal_code ORDER BY lower(city) NULLS FIRST, lat, lon) = 1),
     k AS (SELECT lower(city) AS c, lat, lon, canton FROM plz_coords WHERE city IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(city) ORDER BY postal_code NULLS FIRST, lat, lon) = 1),
     j AS (SELECT id, j.lat AS la, j.lon AS lo, j.canton AS ca, e.postal_code IS NOT NULL AS t1, p.postal_code IS NOT NULL AS t2, k.c IS NOT NULL AS t3,
                  e.lat AS lat1, e.lon AS lon1, e.canton AS c1, p.lat AS lat2, p.lon AS lon2, p.canton AS c2, k.lat AS lat3, k.lon AS lon3, k.canton AS c3
           FROM jobs j LEFT JOIN e ON e.postal_code = j.postal_code AND e.c = lower(j.city) LEFT JOIN p ON p.postal_code = j.postal_code LEFT JOIN k ON k.c = lower(j.city))
SELECT id, CASE WHEN la IS NULL OR lo IS NULL THEN CASE WHEN t1 THEN lat1 WHEN t2 THEN lat2 WHEN t3 THEN lat3 END ELSE la END AS lat,
       CASE WHEN la IS NULL OR lo IS NULL THEN CASE WHEN t1 THEN lon1 WHEN t2 THEN lon2 WHEN t3 THEN lon3 END ELSE lo END AS lon,
       coalesce(ca, CASE WHEN t1 THEN c1 WHEN t2 THEN c2 WHEN t3 THEN c3 END) AS canton,
       CASE WHEN la IS NULL OR lo IS NULL THEN CASE WHEN t1 THEN 1 WHEN t2 THEN 2 WHEN t3 THEN 3 END END AS geo_tier
FROM j
"""
)
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing coordinates from three tiers of lookups."""
    jobs = table(spark, sf_dir, "jobs", "id", "postal_code", "city", "canton", "lat", "lon")
    return geocode(jobs, table(spark, sf_dir, "plz_coords")).select("id", "lat", "lon", "canton", "geo_tier")


_PROFILES = f"""
WITH b AS (SELECT {_company('company_name')} AS k, company_name, id, occupation_codes AS codes, nullif(city, '') AS city,
                  CASE WHEN lon IS NOT NULL THEN lat END AS la, CASE WHEN lat IS NOT NULL THEN lon END AS lo, coalesce(company_is_agency, false) AS d FROM jobs),
     m AS (SELECT k, arg_min(company_name, id) AS name, count(*) AS ads, bool_or(d) AS declared, avg(la) AS cla, avg(lo) AS clo, count(la) AS points, count(DISTINCT city) AS cities FROM b GROUP BY k),
     c AS (SELECT k, count(DISTINCT code) AS codes FROM (SELECT k, unnest(codes) AS code FROM b) GROUP BY k),
     s AS (SELECT b.k, avg(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(cla - la) / 2), 2) + cos(radians(la)) * cos(radians(cla)) * pow(sin(radians(clo - lo) / 2), 2))))) AS spread
           FROM b JOIN m ON m.k = b.k WHERE la IS NOT NULL GROUP BY b.k)
SELECT m.k AS company_key, name, ads, declared AS declared_agency, coalesce(c.codes, 0) AS codes, cities, round(coalesce(c.codes, 0) / ads, 6) AS code_ratio, round(CASE WHEN points >= 2 THEN spread ELSE 0 END, 4) AS spread_km
FROM m LEFT JOIN c ON c.k = m.k LEFT JOIN s ON s.k = m.k
"""


def _jobs_for_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "jobs", "id", "company_name", "occupation_codes", "city", "lat", "lon", "company_is_agency", "description_md")


@query(_PROFILES)
def company_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers by what they publish (A1-A3)."""
    p = company.company_profiles(_jobs_for_profiles(spark, sf_dir))
    return p.select("company_key", "name", "ads", "declared_agency", "codes", "cities", F.round("code_ratio", 6).alias("code_ratio"), F.round("spread_km", 4).alias("spread_km"))


_J = lambda pattern: "'(?i)" + pattern.replace("'", "''") + "'"


@query(
    f"""
WITH b AS (SELECT {_company('company_name')} AS k, company_name, id, occupation_codes AS codes, nullif(city, '') AS city,
                  CASE WHEN lon IS NOT NULL THEN lat END AS la, CASE WHEN lat IS NOT NULL THEN lon END AS lo, coalesce(company_is_agency, false) AS d,
                  regexp_matches({_strip('description_md')}, {_J(V.CLIENT_MENTION)}) AS mention FROM jobs),
     m AS (SELECT k, arg_min(company_name, id) AS name, count(*) AS ads, bool_or(d) AS declared, count(*) FILTER (mention) AS mentions, avg(la) AS cla, avg(lo) AS clo, count(la) AS points, count(DISTINCT city) AS cities FROM b GROUP BY k),
     c AS (SELECT k, count(DISTINCT code) AS codes FROM (SELECT k, unnest(codes) AS code FROM b) GROUP BY k),
     s AS (SELECT b.k, avg(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(cla - la) / 2), 2) + cos(radians(la)) * cos(radians(cla)) * pow(sin(radians(clo - lo) / 2), 2))))) AS spread
           FROM b JOIN m ON m.k = b.k WHERE la IS NOT NULL GROUP BY b.k),
     p AS (SELECT m.k, ads, declared, regexp_matches(name, {_J(V.AGENCY_NAME)}) AS named, regexp_matches(name, {_J(V.PUBLIC_EMPLOYER)}) AS public,
                  ads >= {V.PATTERN_MIN_ADS} AND coalesce(c.codes, 0) / ads >= {V.PATTERN_MIN_CODE_RATIO} AND mentions >= {V.PATTERN_MIN_CLIENT_MENTIONS}
                  AND (cities >= {V.PATTERN_MIN_CITIES} OR CASE WHEN points >= 2 THEN spread ELSE 0 END >= {V.PATTERN_MIN_SPREAD_KM}) AS pattern
           FROM m LEFT JOIN c ON c.k = m.k LEFT JOIN s ON s.k = m.k)
SELECT CASE WHEN named THEN '{V.AGENCY_REASONS["name"]}' WHEN declared THEN '{V.AGENCY_REASONS["declared"]}' ELSE 'Muster' END AS signal, sum(ads)::BIGINT AS ads
FROM p WHERE named OR (NOT public AND (declared OR pattern)) GROUP BY signal
"""
)
def publisher_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers classified, put back on rows and summed by signal."""
    return company.agency_summary(company.annotate_jobs(_jobs_for_profiles(spark, sf_dir)))


# --- inventory and feedback ------------------------------------------------------------------------
@query(
    """
SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (company_is_agency) AS agencies,
       round(100.0 * count(*) FILTER (company_is_agency) / count(*), 1) AS agency_pct, count(DISTINCT cluster_id) AS clusters,
       count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS located, count(*) FILTER (is_group_representative) AS representatives
FROM jobs
"""
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the whole table in one aggregate."""
    jobs = table(spark, sf_dir, "jobs", "status", "company_is_agency", "cluster_id", "lat", "lon", "is_group_representative")
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("company_is_agency").alias("agencies"),
        F.round(100.0 * F.count_if("company_is_agency") / F.count(F.lit(1)), 1).alias("agency_pct"), F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("located"), F.count_if("is_group_representative").alias("representatives"),
    )


@query("SELECT portal, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, portal) AS position FROM jobs GROUP BY portal")
def portal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per portal in order."""
    counts = table(spark, sf_dir, "jobs", "portal").groupBy("portal").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "portal")).cast("long"))


@query("SELECT company_name, count(*) AS ads, count(DISTINCT content_hash) AS texts FROM jobs GROUP BY company_name ORDER BY ads DESC, company_name LIMIT 20")
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the most advertisements."""
    jobs = table(spark, sf_dir, "jobs", "company_name", "content_hash")
    return jobs.groupBy("company_name").agg(F.count(F.lit(1)).alias("ads"), F.count_distinct("content_hash").alias("texts")).orderBy(F.desc("ads"), "company_name").limit(20)


@query("SELECT profile, CASE rating WHEN 1 THEN 'interessant' WHEN 0 THEN 'vielleicht' ELSE 'nein' END AS label, coalesce(reason, '') AS reason, count(*) AS n FROM feedback GROUP BY ALL")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by label and reason."""
    label = F.create_map(*(F.lit(x) for kv in delivery.RATING_LABELS.items() for x in kv))[F.col("rating")]
    return table(spark, sf_dir, "feedback", "profile", "rating", "reason").groupBy("profile", label.alias("label"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT profile, round(avg(score_seen) FILTER (rating = 1) - avg(score_seen) FILTER (rating = -1), 4) AS separation, count(*) AS ratings FROM feedback GROUP BY profile")
def rating_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far scores tell good from bad."""
    return delivery.separation(table(spark, sf_dir, "feedback", "profile", "rating", F.col("score_seen").alias("score")))


@query(
    """
WITH n AS (SELECT profile, reason, count(*) AS n FROM feedback WHERE rating = -1 AND reason IS NOT NULL GROUP BY ALL), t AS (SELECT profile, sum(n) AS total FROM n GROUP BY profile)
SELECT n.profile, reason, n, round(n / total, 6) AS share,
       round(CASE reason WHEN 'Pensum' THEN 0.5 WHEN 'zu weit weg' THEN 0.8 WHEN 'Vermittler' THEN 0.35 WHEN 'falscher Beruf' THEN 1.0 END * (1 + n / total), 2) AS suggested
FROM n JOIN t ON t.profile = n.profile
"""
)
def suggested_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that rejections suggest."""
    done = delivery.weight_suggestions(table(spark, sf_dir, "feedback"), {"workload": 0.5, "location": 0.8, "agency_penalty": 0.35, "semantic": 1.0})
    return done.withColumn("share", F.round("share", 6))


@query(f"SELECT s.profile, count(*) AS open FROM {LATEST} s WHERE NOT EXISTS (SELECT 1 FROM feedback f WHERE f.profile = s.profile AND f.job_rowid = s.job_rowid) GROUP BY s.profile")
def unrated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored but unrated jobs by anti-join."""
    return delivery.unrated(_latest_scores(spark, sf_dir), table(spark, sf_dir, "feedback")).groupBy("profile").agg(F.count(F.lit(1)).alias("open"))


# --- rankings --------------------------------------------------------------------------------------
@query(
    f"""
SELECT profile, job_rowid, company_name, is_new, position FROM (
  SELECT d.profile, d.job_rowid, company_name, f.job_rowid IS NULL AS is_new, row_number() OVER (PARTITION BY d.profile ORDER BY final_score DESC, d.job_rowid) AS position
  FROM (SELECT s.profile, s.job_rowid, final_score, company_name FROM {LATEST} s JOIN jobs j ON j.id = s.job_rowid
        QUALIFY row_number() OVER (PARTITION BY s.profile, company_name ORDER BY final_score DESC, s.job_rowid) <= 3) d
  LEFT JOIN feedback f ON f.profile = d.profile AND f.job_rowid = d.job_rowid) WHERE position <= 15
"""
)
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best jobs per profile, three per company, flagged if new."""
    jobs = table(spark, sf_dir, "jobs", "id", "company_name", "title", "workload_min", "workload_max", "description_md", "group_id")
    done = delivery.digest(_latest_scores(spark, sf_dir), jobs, table(spark, sf_dir, "feedback", "profile", "job_rowid"))
    return done.select("profile", "job_rowid", "company_name", "is_new", F.col("position").cast("long").alias("position"))


@query(
    f"""
WITH d AS (SELECT d.profile, f.job_rowid IS NULL AS is_new, row_number() OVER (PARTITION BY d.profile ORDER BY final_score DESC, d.job_rowid) AS position
  FROM (SELECT s.profile, s.job_rowid, final_score, company_name FROM {LATEST} s JOIN jobs j ON j.id = s.job_rowid
        QUALIFY row_number() OVER (PARTITION BY s.profile, company_name ORDER BY final_score DESC, s.job_rowid) <= 3) d
  LEFT JOIN feedback f ON f.profile = d.profile AND f.job_rowid = d.job_rowid),
  s AS (SELECT profile, count(*) AS n FROM feedback GROUP BY profile),
  r AS (SELECT profile, count(*) AS shown, count(*) FILTER (is_new) AS new_count FROM d WHERE position <= 15 GROUP BY profile)
SELECT coalesce(r.profile, s.profile) AS profile, CASE WHEN r.profile IS NULL THEN 0 ELSE 1 END AS digests, coalesce(s.n, 0) + coalesce(new_count, 0) AS already_shown, shown, new_count
FROM r FULL JOIN s ON s.profile = r.profile
"""
)
def digest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest recorded: the run, what is shown for the first time, and the totals after it."""
    entries = digests(spark, sf_dir)
    before = table(spark, sf_dir, "feedback", "profile", "job_rowid", F.col("created_at").alias("first_shown_at"))
    seen, runs = delivery.record_digest(entries, F.lit(NOW).cast("timestamp_ntz"))
    after = store.record_entries(before, seen, ["profile", "job_rowid"])
    last = delivery.last_digest(runs).select("profile", "shown", "new_count")
    return delivery.digest_stats(runs, after).withColumn("digests", F.col("digests").cast("int")).join(last, "profile", "left")


@query(
    f"""
SELECT profile, job_rowid, row_number() OVER (PARTITION BY profile ORDER BY final_score DESC, job_rowid) AS position FROM (
  SELECT s.profile, s.job_rowid, s.final_score FROM (SELECT * FROM {LATEST} QUALIFY row_number() OVER (PARTITION BY profile ORDER BY final_score DESC, job_rowid) <= 60) s
  JOIN jobs j ON j.id = s.job_rowid WHERE j.expires_at BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 30 DAY
  AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.profile = s.profile AND f.job_rowid = s.job_rowid))
QUALIFY position <= 5
"""
)
def expiring_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good jobs that end soon and weren't shown."""
    now = F.lit(NOW).cast("timestamp_ntz")
    done = delivery.expiring(_latest_scores(spark, sf_dir), table(spark, sf_dir, "jobs", "id", "expires_at"), table(spark, sf_dir, "feedback"), now=now, days=30)
    return done.select("profile", "job_rowid", F.col("position").cast("long").alias("position"))


@query(
    f"""
SELECT profile, job_rowid, round(CASE WHEN n = 1 THEN 1.0 ELSE (r - 1) / (n - 1) END, 9) AS spread FROM (
  SELECT profile, job_rowid, row_number() OVER (PARTITION BY profile ORDER BY semantic_raw, job_rowid) AS r, count(*) OVER (PARTITION BY profile) AS n
  FROM {LATEST} WHERE semantic_raw IS NOT NULL AND NOT isnan(semantic_raw))
"""
)
def spread_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities spread over 0..1 by rank."""
    rows = _latest_scores(spark, sf_dir).where(F.col("semantic_raw").isNotNull() & ~F.isnan("semantic_raw"))
    return ranking.rank_spread(rows, ["profile"], "semantic_raw", "job_rowid").select("profile", "job_rowid", F.round("spread", 9).alias("spread"))


@query("SELECT vec_id, round((row_number() OVER (ORDER BY embedding[1], vec_id) - 1) / (count(*) OVER () - 1), 9) AS spread FROM embeddings")
def spread_ranks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a whole table, by range partitions and their offsets (W1 at scale)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"))
    return ranking.rank_spread_distributed(rows, "x", "vec_id").select("vec_id", F.round("spread", 9).alias("spread"))


PLACES = [("Nord", 47.37, 8.54, 25.0), ("Sued", 46.2, 8.95, 20.0), ("West", 46.52, 6.63, 15.0)]
_D = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin(radians({c} - lon) / 2), 2)))"
_FIT = "CASE WHEN {d} <= {r} THEN 1.0 WHEN {d} <= 2 * {r} THEN 1 - ({d} - {r}) / {r} ELSE 0.0 END"


@query(
    "SELECT id, round(least(" + ", ".join(_D.format(b=b, c=c) for _, b, c, _ in PLACES) + "), 5) AS distance_km, CASE WHEN lat IS NULL OR lon IS NULL THEN 0.4 ELSE round(greatest("
    + ", ".join(_FIT.format(d=_D.format(b=b, c=c), r=r) for _, b, c, r in PLACES) + "), 6) END AS location_fit, "
    "CASE WHEN workload_min IS NULL AND workload_max IS NULL THEN 0.5 WHEN least(coalesce(workload_max, 100), 90) >= greatest(coalesce(workload_min, 0), 60) THEN 1.0 "
    "ELSE round(greatest(0.0, 1 - greatest(60 - coalesce(workload_max, 100), coalesce(workload_min, 0) - 90) / 30.0) * 0.3, 6) END AS workload_fit, "
    f"round(coalesce(pow(0.5, greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', posted_at))) / 86400) / 21.0), 0.5), 6) AS recency FROM jobs"
)
def soft_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, interval fits and half-lives as soft scores."""
    jobs = table(spark, sf_dir, "jobs", "id", "lat", "lon", "workload_min", "workload_max", "posted_at")
    km = [haversine_km(F.col("lat"), F.col("lon"), F.lit(b), F.lit(c)) for _, b, c, _ in PLACES]
    fits = [ranking.distance_fit(d, r) for d, (*_, r) in zip(km, PLACES)]
    return jobs.select(
        "id", F.round(F.least(*km), 5).alias("distance_km"), F.round(F.greatest(*fits), 6).alias("location_fit"),
        F.round(ranking.interval_fit(F.col("workload_min"), F.col("workload_max"), 60, 90, 30.0), 6).alias("workload_fit"),
        F.round(ranking.half_life(F.col("posted_at"), F.lit(NOW), 21.0), 6).alias("recency"),
    )


KEYWORDS, UNWANTED = ["gastronomie", "pflege", "technik", "english"], ["nacht", "verkauf", "kontakt"]


def _hits_sql(words: list[str], where: str) -> str:
    inside = {"title": "contains(t, '{w}')", "body": "(contains(b, '{w}') AND NOT contains(t, '{w}'))"}[where]
    return " + ".join(f"{inside.format(w=w)}::INT" for w in words)


@query(
    f"""
SELECT id, round(good, 6) AS good, round(bad, 6) AS bad, round((0.5 * good + 0.3 * office - 1.0 * bad) / 0.8, 6) AS final FROM (
  SELECT id, 1 - exp(-(2.0 * ({_hits_sql(KEYWORDS, 'title')}) + ({_hits_sql(KEYWORDS, 'body')})) / 3.0) AS good,
         least(1.0::DOUBLE, ({_hits_sql(UNWANTED, 'title')}) + 0.25::DOUBLE * ({_hits_sql(UNWANTED, 'body')})) AS bad,
         CASE WHEN home_office THEN 1.0 WHEN regexp_matches(b, '(?i)home\\s?-?office|homeoffice|remote|telearbeit|mobiles?\\s+arbeiten|hybrid') THEN 0.9 ELSE 0.35 END AS office
  FROM (SELECT id, home_office, lower(title) AS t, lower({_strip('description_md')}) AS b FROM jobs))
"""
)
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword saturation, exclusions, and the weighted sum."""
    from gleaner.functions import fixed_values as V
    from gleaner.functions.text import rx, strip_html

    jobs = texts(spark, sf_dir, "jobs", "id", "title", "description_md", "home_office").select("id", "home_office", F.lower("title").alias("t"), F.lower(strip_html(F.col("description_md"))).alias("b"))
    in_title = lambda ws: sum((F.contains(F.col("t"), F.lit(w)).cast("int") for w in ws), F.lit(0))
    in_body = lambda ws: sum(((F.contains(F.col("b"), F.lit(w)) & ~F.contains(F.col("t"), F.lit(w))).cast("int") for w in ws), F.lit(0))
    good = ranking.saturation(in_title(KEYWORDS), in_body(KEYWORDS))
    bad = F.least(F.lit(1.0), in_title(UNWANTED) + 0.25 * in_body(UNWANTED))
    office = F.when(F.col("home_office"), 1.0).when(F.col("b").rlike(rx(V.HOME_OFFICE)), 0.9).otherwise(0.35)
    final = ranking.weighted_score({"keywords": (0.5, good), "home_office": (0.3, office)}, {"exclude": (1.0, bad)})
    return jobs.select("id", F.round(good, 6).alias("good"), F.round(bad, 6).alias("bad"), F.round(final, 6).alias("final"))


@query(
    "SELECT o_custkey, o_orderkey, position FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position "
    "FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2)) WHERE position <= 100"
)
def capped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred, at most two per customer."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    done = ranking.cap_per_group(orders.withColumn("all", F.lit(0)), partition=["all"], group="o_custkey", order=[F.desc("o_totalprice"), F.col("o_orderkey")], cap=2, top=100)
    return done.select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query(
    f"""
SELECT profile, category, n FROM (SELECT profile, category, count(*) AS n, avg(final_score) AS mean FROM (
  SELECT s.profile, s.final_score, unnest(j.categories) AS category FROM {LATEST} s JOIN jobs j ON j.id = s.job_rowid) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY profile ORDER BY round(mean, 9) DESC, n DESC, category) = 1
"""
)
def best_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with the best mean score per profile."""
    jobs = table(spark, sf_dir, "jobs", F.col("id").alias("job_rowid"), "categories")
    rows = _latest_scores(spark, sf_dir).select("profile", "job_rowid", "final_score").join(jobs, "job_rowid").select("profile", "final_score", F.explode("categories").alias("category"))
    means = rows.groupBy("profile", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final_score"), 9).alias("mean"))
    return ranking.first_per_group(means, ["profile"], [F.desc("mean"), F.desc("n"), F.col("category")]).select("profile", "category", "n")


@query(
    f"""
SELECT profile, category, n, row_number() OVER (PARTITION BY profile ORDER BY n DESC, category) AS position FROM (SELECT profile, category, count(*) AS n FROM (
  SELECT s.profile, coalesce(j.categories[1], 'ohne Zuordnung') AS category
  FROM (SELECT * FROM {LATEST} QUALIFY row_number() OVER (PARTITION BY profile ORDER BY final_score DESC, job_rowid) <= 200) s JOIN jobs j ON j.id = s.job_rowid) GROUP BY ALL) QUALIFY position <= 12
"""
)
def head_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories among the first two hundred of each profile."""
    head = ranking.cap_per_group(_latest_scores(spark, sf_dir), partition=["profile"], group="job_rowid", order=ORDER(), cap=1, top=200)
    jobs = table(spark, sf_dir, "jobs", F.col("id").alias("job_rowid"), "categories")
    named = head.join(jobs, "job_rowid").select("profile", F.coalesce(F.get("categories", F.lit(0)), F.lit("ohne Zuordnung")).alias("category"))
    counts = named.groupBy("profile", "category").agg(F.count(F.lit(1)).alias("n"))
    position = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("n"), "category"))
    return counts.withColumn("position", position.cast("long")).where("position <= 12")


@query(
    f"""
SELECT s.profile, s.job_rowid, j.portal, f.rating, f.job_rowid IS NOT NULL AS rated, round(s.final_score, 9) AS final_score
FROM {LATEST} s JOIN jobs j ON j.id = s.job_rowid LEFT JOIN feedback f ON f.profile = s.profile AND f.job_rowid = s.job_rowid
WHERE j.status = 'active' AND NOT j.company_is_agency AND coalesce(j.workload_max, 100) >= 80 AND coalesce(j.workload_min, 0) <= 100
"""
)
def rated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their ratings under the filters of a list."""
    jobs = table(spark, sf_dir, "jobs", F.col("id").alias("job_rowid"), "portal", "status", "company_is_agency", "workload_min", "workload_max")
    kept = jobs.where((F.col("status") == "active") & ~F.col("company_is_agency") & (F.coalesce("workload_max", F.lit(100)) >= 80) & (F.coalesce("workload_min", F.lit(0)) <= 100))
    ratings = table(spark, sf_dir, "feedback", "profile", "job_rowid", "rating").withColumn("rated", F.lit(True))
    joined = _latest_scores(spark, sf_dir).join(kept, "job_rowid").join(ratings, ["profile", "job_rowid"], "left")
    return joined.select("profile", "job_rowid", "portal", "rating", F.coalesce("rated", F.lit(False)).alias("rated"), F.round("final_score", 9).alias("final_score"))


@query("SELECT category, n FROM (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM jobs) GROUP BY category) ORDER BY n DESC, category LIMIT 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent categories."""
    rows = table(spark, sf_dir, "jobs", "categories").select(F.explode("categories").alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(5)


# --- JSON, arrays, sets ----------------------------------------------------------------------------
@query(
    """
SELECT rule, count(*) AS n, round(avg(v), 6) AS mean FROM (
  SELECT unnest(['workload', 'location', 'recency', 'keywords']) AS rule, unnest([try_cast(r->>'$.scores.workload' AS DOUBLE), try_cast(r->>'$.scores.location' AS DOUBLE), try_cast(r->>'$.scores.recency' AS DOUBLE), try_cast(r->>'$.scores.keywords' AS DOUBLE)]) AS v
  FROM (SELECT CASE WHEN json_valid(rules_json) THEN rules_json::JSON END AS r FROM scores)) WHERE v IS NOT NULL GROUP BY rule
"""
)
def rule_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps inside JSON text; broken JSON gives nothing."""
    rules = table(spark, sf_dir, "scores", "rules_json").select(F.expr("try_variant_get(try_parse_json(rules_json), '$.scores', 'map<string,double>')").alias("m"))
    picked = rules.select(F.explode(F.map_filter("m", lambda k, v: k.isin("workload", "location", "recency", "keywords") & v.isNotNull())).alias("rule", "v"))
    return picked.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT id, len(occupation_codes) AS codes, len(categories) AS n_categories FROM jobs WHERE len(list_filter(occupation_codes, lambda c: starts_with(c, '1') OR starts_with(c, '73'))) > 0")
def occupation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a code under one of the prefixes."""
    jobs = table(spark, sf_dir, "jobs", "id", "occupation_codes", "categories")
    wanted = F.exists("occupation_codes", lambda c: c.startswith("1") | c.startswith("73"))
    return jobs.where(wanted).select("id", F.size("occupation_codes").cast("long").alias("codes"), F.size("categories").cast("long").alias("n_categories"))


@query("SELECT home_office, is_permanent, count(*) AS n FROM jobs WHERE status = 'active' AND NOT company_is_agency GROUP BY ALL")
def tristate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued flags stay three-valued; filters reach the scan."""
    jobs = table(spark, sf_dir, "jobs", "home_office", "is_permanent", "status", "company_is_agency")
    return jobs.where((F.col("status") == "active") & ~F.col("company_is_agency")).groupBy("home_office", "is_permanent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cluster_id, array_to_string(list_sort(list(DISTINCT city))[1:8], '|') AS places FROM jobs WHERE cluster_id IS NOT NULL AND coalesce(city, '') <> '' GROUP BY cluster_id")
def cluster_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight places of each cluster."""
    jobs = table(spark, sf_dir, "jobs", F.col("cluster_id").alias("group_id"), "city")
    return delivery.group_places(jobs).select(F.col("group_id").alias("cluster_id"), F.array_join("places", "|").alias("places"))


@query(
    "SELECT portal, source_id FROM (SELECT portal, source_id FROM jobs WHERE portal <> 'job_room' UNION ALL SELECT regexp_extract(_source_url, '//www\\.([a-z]+)\\.', 1), id::VARCHAR FROM ch_media_vacancies) "
    "EXCEPT SELECT portal, source_id FROM source_items"
)
def unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of both tables that the seen-set doesn't know."""
    a = table(spark, sf_dir, "jobs", "portal", "source_id").where("portal <> 'job_room'")
    b = table(spark, sf_dir, "ch_media_vacancies", "_source_url", "id").select(F.regexp_extract("_source_url", r"//www\.([a-z]+)\.", 1).alias("portal"), F.col("id").cast("string").alias("source_id"))
    return store.unseen(a.unionByName(b), table(spark, sf_dir, "source_items"), ["portal", "source_id"]).select("portal", "source_id")


@query("SELECT portal, source_id FROM source_items WHERE fetched_at IS NULL ORDER BY try_cast(source_id AS BIGINT) DESC NULLS LAST, source_id DESC, portal LIMIT 200")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next entries to fetch."""
    rows = store.pending(table(spark, sf_dir, "source_items", "portal", "source_id", "fetched_at"))
    return rows.orderBy(F.col("source_id").try_cast("bigint").desc_nulls_last(), F.col("source_id").desc(), "portal").limit(200).select("portal", "source_id")


# --- table maintenance -----------------------------------------------------------------------------
_FIRST = "(SELECT * FROM jobs WHERE portal IS NOT NULL AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY portal, source_id ORDER BY last_seen_at {d}, id {d}) = 1)"


@query(
    f"""
SELECT coalesce(o.portal, n.portal) AS portal, coalesce(o.source_id, n.source_id) AS source_id, n.title AS title, n.last_seen_at AS last_seen_at, o.posted_at AS posted_at, o.first_seen_at AS first_seen_at
FROM {_FIRST.format(d='ASC')} o FULL JOIN {_FIRST.format(d='DESC')} n ON o.portal = n.portal AND o.source_id = n.source_id
"""
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later deliveries over earlier ones: some columns change, some stay."""
    cols = ["portal", "source_id", "title", "last_seen_at", "posted_at", "first_seen_at"]
    jobs = table(spark, sf_dir, "jobs", "id", *cols)
    keys = ["portal", "source_id"]
    by = Window.partitionBy(*keys)
    pick = lambda *o: jobs.dropna(subset=keys).withColumn("r", F.row_number().over(by.orderBy(*o))).where("r = 1").select(*cols)
    return store.upsert(pick(F.asc("last_seen_at"), F.asc("id")), pick(F.desc("last_seen_at"), F.desc("id")), keys, ["title", "last_seen_at"])


@query(f"SELECT CASE WHEN status = 'active' AND expires_at < TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY ALL")
def expired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status at a fixed moment."""
    jobs = table(spark, sf_dir, "jobs", "status", "expires_at")
    return store.mark_expired(jobs, F.lit(NOW).cast("timestamp_ntz")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, k, n FROM (SELECT user_id, event_type, try_cast(props->>'$.k' AS BIGINT) AS k, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user with a value from its JSON."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "props"), F.struct("ts", "event_id")).alias("e"), F.count(F.lit(1)).alias("n"))
    return last.select("user_id", "e.event_type", F.get_json_object("e.props", "$.k").try_cast("bigint").alias("k"), "n")


# --- vectors ---------------------------------------------------------------------------------------
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    f"SELECT vec_id, round(max(s), 5) AS similarity, arg_min(role, [-s, role]) AS role FROM (SELECT a.vec_id, b.vec_id AS role, {_DOT} AS s FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5) b) GROUP BY vec_id"
)
def best_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest of five roles."""
    vecs = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    roles = vecs.orderBy("vec_id").limit(5).collect()
    best, at = vectors.cosine_max(F.col("embedding"), [r["embedding"] for r in roles])
    names = F.array(*(F.lit(r["vec_id"]) for r in roles))
    return vecs.select("vec_id", F.round(best, 5).alias("similarity"), F.get(names, at).alias("role"))


@query(
    f"""
WITH e AS (SELECT vec_id, embedding, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS label FROM embeddings),
     n AS (SELECT a.vec_id AS p, b.vec_id AS r, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k
           FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a, e b WHERE a.vec_id <> b.vec_id),
     v AS (SELECT p, label, count(*) AS c, min(k) AS f, arg_min(r, k) AS best FROM n WHERE k <= 12 GROUP BY ALL)
SELECT p AS vec_id, label, round(c / 12, 2) AS agreement, best FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY c DESC, f) = 1 AND c / 12 >= 0.4
"""
)
def voted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority among the twelve nearest of all others, for every hundredth vector.

    The labels are planted, by the signs of two components: those of the table have no majorities.
    """
    sign = lambda i, n: F.when(F.element_at("embedding", i) > 0, n).otherwise(0)
    vecs = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("label", sign(1, 2) + sign(2, 1))
    queries = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("p_id"), F.col("embedding").alias("v"))
    near = terms.nearest(queries, vecs.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("r_v"), "label"), 13).where("p_id <> r_id")
    again = F.row_number().over(Window.partitionBy("p_id").orderBy("position"))
    near = near.withColumn("position", again).where("position <= 12")
    return terms.majority_vote(near, "label").select(F.col("p_id").alias("vec_id"), "label", "agreement", "best")


@query()
def clustered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors; small ones are noise."""
    return terms.vector_clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), key="vec_id", vector="embedding")


@query()
def portal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vacancy on several portals, by fuzzy titles and companies."""
    return dedup.cross_portal_clusters(texts(spark, sf_dir, "jobs", "id", "portal", "title", "company_name", "city", "postal_code", "description_md", "apply_url"))


# --- sources ---------------------------------------------------------------------------------------
@query("SELECT source_id, url, lastmod FROM source_items WHERE regexp_matches(url, '/job/[^/]+/\\d+')")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as sitemap XML and read back."""
    items = table(spark, sf_dir, "source_items", "url", "lastmod")
    stamp = F.coalesce(F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    xml = items.select(F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc><lastmod>"), stamp, F.lit("</lastmod></url></urlset>")).alias("xml"))
    return web.parse_sitemap(xml).withColumn("lastmod", F.col("lastmod").cast("timestamp_ntz"))


@query("SELECT DISTINCT id, title, CASE WHEN id % 5 < 2 THEN 'gone' WHEN coalesce(company.name, '') = '' THEN 'missing' ELSE 'ok' END AS outcome, CASE id % 5 WHEN 0 THEN 404 WHEN 1 THEN 410 ELSE 200 END AS http_status FROM ch_media_vacancies")
def embedded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancies embedded in pages and taken out again; two in five are gone, by status or by title."""
    rows = table(spark, sf_dir, "ch_media_vacancies", "id", "title", "activity", "company")
    data = F.when(F.coalesce("company.name", F.lit("")) == "", F.lit("{}")).otherwise(F.to_json(F.struct("id", "title", "activity")))
    head = F.when(F.pmod("id", F.lit(5)) == 1, "<title>Stelle nicht mehr da</title>").otherwise("<title>Stelle</title>")
    page = F.concat(head, F.lit("<script>window.__PRELOADED_STATE__ = {\"x\":\"}\",\"vacancyDetails\":{\"data\":"), data, F.lit("}};</script>"))
    done = web.route_fetches(rows.select(F.col("id").cast("string").alias("source_id"), F.when(F.pmod("id", F.lit(5)) == 0, 404).otherwise(200).alias("http_status"), page.alias("html"), "id", "title"))
    return done.select("id", "title", "outcome", "http_status").distinct()


@query(
    f"""
SELECT DISTINCT id::VARCHAR AS source_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, workplace_zip AS postal_code, type_value_min AS workload_min,
       CASE WHEN type_value_min > type_value_max THEN type_value_min ELSE coalesce(type_value_max, type_value_min) END AS workload_max, home_office, coalesce(nullif(url_application, ''), nullif(url_description, '')) AS apply_url,
       len(list_filter(categories, lambda c: coalesce(c.title, '') <> '')) AS n_categories, length({_strip("concat_ws(chr(10), nullif(activity, ''), nullif(requirements, ''))")}) < 350
         OR coalesce(lower(regexp_extract(url_description, '^https?://([^/:?#]+)', 1)) <> lower(regexp_extract(_source_url, '^https?://([^/:?#]+)', 1)), false) AS description_truncated
FROM ch_media_vacancies WHERE coalesce(trim(title), '') <> '' AND coalesce(trim(company.name), '') <> ''
"""
)
def projected_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat vacancies in canonical form."""
    rows = table(spark, sf_dir, "ch_media_vacancies").withColumn("portal", F.regexp_extract("_source_url", r"//www\.([a-z]+)\.", 1))
    done = raw.project_b(rows, F.lit(NOW).cast("timestamp"))
    return done.select("source_id", "title", "postal_code", "workload_min", "workload_max", "home_office", "apply_url", F.size("categories").cast("long").alias("n_categories"), "description_truncated").distinct()


_REDACTED = lambda c: f"regexp_replace(regexp_replace({c}, '(?i)[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.]{{2,}}', '[E-Mail entfernt]', 'g'), {_J(V.PHONE)}, '[Telefon entfernt]', 'g')"


@query(
    f"""
SELECT DISTINCT id, {_REDACTED('title')} AS title, md5({_REDACTED('activity')}) AS activity, md5({_REDACTED('requirements')}) AS requirements, coalesce(has_contact_person, false) AS has_contact_person, 0 AS leaks,
       CASE WHEN regexp_matches(trim(url_application), '(?i)^https?://[^/?#\\s@]+([/?#]\\S*)?$') AND NOT regexp_matches(url_application, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.]{{2,}}') THEN trim(url_application) END AS url_application
FROM ch_media_vacancies
"""
)
def scrubbed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of source B as JSON with a contact, after the typed scrub."""
    rows = table(spark, sf_dir, "ch_media_vacancies", "id", "title", "activity", "requirements", "url_application", "has_contact_person")
    contact = F.when(F.col("has_contact_person"), F.lit("<p>Anna Muster, <a href='mailto:anna@muster.example'>Mail</a>, 044 123 45 67</p>"))
    doc = F.to_json(F.struct("id", "title", "activity", "requirements", "url_application", contact.alias("contact")))
    done = rows.select("id", scrub_source_b(doc).alias("j"))
    of = lambda name: F.get_json_object("j", f"$.{name}")
    return done.select(
        "id", of("title").alias("title"), F.md5(of("activity")).alias("activity"), F.md5(of("requirements")).alias("requirements"), of("url_application").alias("url_application"),
        (of("has_contact_person") == "true").alias("has_contact_person"), F.size(contact_leaks("j")).alias("leaks"),
    ).distinct()


# --- positions -------------------------------------------------------------------------------------
@query(
    "SELECT DISTINCT a.postal_code AS code_a, b.postal_code AS code_b FROM plz_coords a JOIN plz_coords b ON a.postal_code < b.postal_code AND abs(a.lat - b.lat) < 0.03 AND "
    "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 2.0"
)
def neighbouring_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes near each other: a table joined with itself by cells."""
    places = table(spark, sf_dir, "plz_coords", "postal_code", "lat", "lon")
    key = ("postal_code", "lat", "lon")
    return points_within(places, places, 2.0, point=key, center=key, out=("code_a", "code_b")).where("code_a < code_b")


@query(
    "WITH r AS (SELECT canton, min(lat) - 0.0007 AS s, max(lat) + 0.0007 AS n, min(lon) - 0.0007 AS w, max(lon) + 0.0007 AS e FROM plz_coords WHERE canton IS NOT NULL GROUP BY canton) "
    "SELECT DISTINCT id, r.canton FROM jobs JOIN r ON lat > s AND lat < n AND lon > w AND lon < e"
)
def jobs_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the boxes of the cantons, as rings of four corners."""
    codes = table(spark, sf_dir, "plz_coords", "canton", "lat", "lon").where("canton IS NOT NULL")
    edge = 0.0007
    box = codes.groupBy("canton").agg((F.min("lat") - edge).alias("s"), (F.max("lat") + edge).alias("n"), (F.min("lon") - edge).alias("w"), (F.max("lon") + edge).alias("e"))
    corner = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    rings = box.select("canton", F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w")).alias("ring"))
    return points_in_regions(table(spark, sf_dir, "jobs", "id", "lat", "lon"), rings, region=("canton", "ring"), out=("id", "canton"))
