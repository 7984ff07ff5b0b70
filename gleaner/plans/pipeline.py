"""Compositions: raw records to the canonical table, and a table to a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.geo import haversine_km
from gleaner.functions.language import detect_language, matches_language
from gleaner.functions.text import job_text, quote, reconcile_workload, rx, strip_html, truncate, workload_label
from gleaner.functions.vectors import HashingEmbedder, cache_key, cosine_max, embed_udf
from gleaner.operators import company, dedup, ranking
from gleaner.operators.lookup import geocode
from gleaner.session import cut
from gleaner.sources.raw import last_path_wins
from gleaner.sources.settings import Profile


def parse(records: DataFrame, places: DataFrame, *, with_clusters: bool = True) -> DataFrame:
    """Canonical records of all sources → the normalised, located, classified, deduplicated table.

    Order matters: the last path wins; workloads and language per row; places before publishers (whose
    spread needs positions); clusters and groups side by side; a row represents its group only if
    it is the head of its cluster too.
    """
    rows = last_path_wins(records)
    lo, hi, from_title = reconcile_workload(F.col("title"), F.col("workload_min"), F.col("workload_max"))
    rows = rows.select("*", lo.alias("__lo"), hi.alias("__hi"), from_title.alias("workload_from_title"))
    rows = rows.withColumn("workload_min", F.col("__lo")).withColumn("workload_max", F.col("__hi")).drop("__lo", "__hi")
    rows = rows.withColumn("description_language", detect_language(F.col("description_md"))).withColumn("id", F.xxhash64("portal", "source_id"))
    located = cut(geocode(rows, places))
    classified = company.annotate_jobs(located).drop("company_key")
    groups = dedup.exact_groups(located)
    if with_clusters:
        groups = dedup.merge_representatives(groups, dedup.cross_portal_clusters(located))
    return classified.join(groups, "id")


def embed_texts(texts: DataFrame, cache: DataFrame | None, embedder=None, *, text: str = "text", task: str = "retrieval") -> DataFrame:
    """texts(…, text) → adds cache_key and vector; only texts that the cache lacks are embedded, once each.

    `cache` is a table (cache_key, vector) or None. The new entries are those of the result whose key
    the cache doesn't know: append them with `store.unseen`.
    """
    embedder = embedder or HashingEmbedder()
    keyed = texts.withColumn("cache_key", cache_key(F.lit(embedder.name), embedder.dim, task, truncate(F.col(text))))
    wanted = keyed.select("cache_key", truncate(F.col(text)).alias("t")).dropDuplicates(["cache_key"])
    missing = wanted if cache is None else wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = missing.select("cache_key", embed_udf(embedder)("t").alias("vector"))
    known = fresh if cache is None else fresh.unionByName(cache.select("cache_key", "vector"))
    return keyed.join(known, "cache_key")


def candidates(jobs: DataFrame, profile: Profile) -> DataFrame:
    """Active representatives in a wanted language and occupation; filters reach the scan where they can."""
    rows = jobs.where((F.col("status") == "active") & F.col("is_group_representative"))
    if not profile.include_agencies:
        rows = rows.where(~F.col("company_is_agency"))
    if profile.occupation_prefixes:
        rows = rows.where(F.exists(F.coalesce("occupation_codes", F.array().cast("array<string>")), lambda c: _starts_with_any(c, profile.occupation_prefixes)))
    return rows.where(matches_language(F.col("description_language"), profile.description_languages))


def _starts_with_any(code: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | code.startswith(p)
    return out


def _hits(words: list[str], within: Column, unless: Column | None = None) -> Column:
    out = F.lit(0)
    for w in words:
        hit = F.contains(within, F.lit(w.lower()))
        out = out + (hit if unless is None else hit & ~F.contains(unless, F.lit(w.lower()))).cast("int")
    return out


def rule_scores(rows: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """Adds `scores` map<string,double>, `reasons` map<string,string> (no empty ones) and `distance_km`."""
    title, body = F.lower("title"), F.lower(strip_html(F.col("description_md")))
    km = [haversine_km(F.col("lat"), F.col("lon"), F.lit(p.lat), F.lit(p.lon)) for p in profile.locations if p.lat is not None and p.lon is not None]
    radii = [p.radius_km for p in profile.locations if p.lat is not None and p.lon is not None]
    place = F.greatest(*fits) if len(fits := [ranking.distance_fit(d, r) for d, r in zip(km, radii)]) > 1 else fits[0] if fits else F.lit(0.4)
    distance = F.least(*km) if len(km) > 1 else km[0] if km else F.lit(None).cast("double")
    flex = F.when(quote(F.col("description_md"), V.FLEXTIME).isNotNull(), 1.0).otherwise(0.35) if profile.wants_flextime else F.lit(0.5)
    home = F.when(F.col("home_office"), 1.0).when(body.rlike(rx(V.HOME_OFFICE)), 0.9).otherwise(0.35) if profile.wants_home_office else F.lit(0.5)
    good = ranking.saturation(_hits(profile.keywords_positive, title), _hits(profile.keywords_positive, body, title)) if profile.keywords_positive else F.lit(0.5)
    bad = F.least(F.lit(1.0), _hits(profile.keywords_exclude, title) + 0.25 * _hits(profile.keywords_exclude, body, title)) if profile.keywords_exclude else F.lit(0.0)
    scores = {
        "workload": ranking.interval_fit(F.col("workload_min"), F.col("workload_max"), profile.workload_min, profile.workload_max, V.WORKLOAD_TOLERANCE),
        "location": place,
        "flextime": flex,
        "home_office": home,
        "keywords": good,
        "recency": ranking.half_life(F.col("posted_at"), now, V.RECENCY_HALF_LIFE_DAYS),
        "exclude_penalty": bad.cast("double"),
        "agency_penalty": F.col("company_is_agency").cast("int").cast("double"),
    }
    reasons = {
        "workload": F.concat(F.lit("Pensum "), workload_label(F.col("workload_min"), F.col("workload_max"))),
        "location": F.when(distance.isNotNull(), F.format_string("%.1f km", distance)),
        "flextime": quote(F.col("description_md"), V.FLEXTIME),
        "agency_penalty": F.when(F.col("company_is_agency"), F.lit("Personalvermittler")),
    }
    as_map = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v)))
    rounded = F.transform_values(as_map(scores), lambda k, v: F.bround(v, 4))
    kept = F.map_filter(as_map(reasons), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return rows.withColumn("distance_km", distance).withColumn("scores", rounded).withColumn("reasons", kept)


def score(jobs: DataFrame, profile: Profile, now: Column, *, cache: DataFrame | None = None, embedder=None) -> DataFrame:
    """The ranking of a profile: similarity to its roles spread by rank, rules, and the weighted sum."""
    embedder = embedder or HashingEmbedder()
    pool = candidates(jobs, profile).withColumn("text", job_text(F.col("title"), F.col("company_name"), F.col("description_md")))
    roles = [[float(x) for x in v] for v in embedder.embed([f"{r['name']} {r.get('description', '')}".strip() for r in profile.target_roles])] if profile.target_roles else []
    best, at = cosine_max(F.col("vector"), roles)
    names = F.array(*(F.lit(r["name"]) for r in profile.target_roles)) if profile.target_roles else F.array().cast("array<string>")
    similar = embed_texts(pool, cache, embedder).withColumn("semantic_raw", best).withColumn("best_role", F.get(names, at))
    spread = ranking.rank_spread_distributed(similar, "semantic_raw", "id", "semantic_spread")
    rated = rule_scores(spread, profile, now)
    w = profile.weights
    s = lambda k: F.col("scores")[k]
    positive = {k: (w.get(k, 0.0), F.col("semantic_spread") if k == "semantic" else s(k)) for k in ("semantic", "workload", "location", "home_office", "flextime", "keywords", "recency")}
    penalties = {k: (w.get(k, 0.0), s(f"{k}_penalty")) for k in ("agency", "exclude")}
    return rated.select(
        F.lit(profile.name).alias("profile"), F.col("id").alias("job_rowid"), ranking.weighted_score(positive, penalties).alias("final_score"),
        "semantic_raw", "semantic_spread", "best_role", "scores", "reasons", "distance_km", now.alias("computed_at"),
    )
