"""Publisher profiles from aggregated behaviour, and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.geo import haversine_km
from gleaner.functions.text import normalize_company, rx, strip_html
from gleaner.operators.lookup import annotate


def company_profiles(jobs: DataFrame, order: str = "id") -> DataFrame:
    """One row per company key: ads, distinct codes and cities, code ratio, spread, declarations, mentions.

    The spread is the mean distance to the centroid (0 below two points). It needs the centroid first, so
    there are two aggregations on the same key; the centroids join back on it.
    """
    base = jobs.select(
        normalize_company(F.col("company_name")).alias("company_key"),
        "company_name",
        F.col(order).alias("load_order"),
        F.coalesce("occupation_codes", F.array().cast("array<string>")).alias("codes"),
        F.nullif("city", F.lit("")).alias("city"),
        F.when(F.col("lon").isNotNull(), F.col("lat")).alias("lat"),
        F.when(F.col("lat").isNotNull(), F.col("lon")).alias("lon"),
        F.coalesce("company_is_agency", F.lit(False)).alias("declared"),
        F.coalesce(strip_html(F.col("description_md")).rlike(rx(V.CLIENT_MENTION)), F.lit(False)).alias("mention"),
    )
    main = base.groupBy("company_key").agg(
        F.min_by("company_name", "load_order").alias("name"),
        F.count(F.lit(1)).alias("ads"),
        F.bool_or("declared").alias("declared_agency"),
        F.count_if("mention").alias("client_mentions"),
        F.avg("lat").alias("clat"),
        F.avg("lon").alias("clon"),
        F.count("lat").alias("points"),
    )
    # distinct values are counted after a pre-aggregation on (company, value): no sets are collected
    codes = base.select("company_key", F.explode("codes").alias("code")).distinct().groupBy("company_key").agg(F.count(F.lit(1)).alias("n_codes"))
    cities = base.where(F.col("city").isNotNull()).select("company_key", "city").distinct().groupBy("company_key").agg(F.count(F.lit(1)).alias("n_cities"))
    off = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    spread = base.where(F.col("lat").isNotNull()).join(main.select("company_key", "clat", "clon"), "company_key").groupBy("company_key").agg(F.avg(off).alias("spread"))
    return (
        main.join(codes, "company_key", "left").join(cities, "company_key", "left").join(spread, "company_key", "left")
        .select(
            "company_key", "name", "ads", "declared_agency", "client_mentions",
            F.coalesce("n_codes", F.lit(0)).alias("codes"),
            F.coalesce("n_cities", F.lit(0)).alias("cities"),
            (F.coalesce("n_codes", F.lit(0)) / F.col("ads")).alias("code_ratio"),
            F.when(F.col("points") >= 2, F.col("spread")).otherwise(0.0).alias("spread_km"),
        )
    )


def matches_pattern() -> Column:
    """Many ads of many occupations for clients, in many places or far apart."""
    return (
        (F.col("ads") >= V.PATTERN_MIN_ADS)
        & (F.col("code_ratio") >= V.PATTERN_MIN_CODE_RATIO)
        & (F.col("client_mentions") >= V.PATTERN_MIN_CLIENT_MENTIONS)
        & ((F.col("cities") >= V.PATTERN_MIN_CITIES) | (F.col("spread_km") >= V.PATTERN_MIN_SPREAD_KM))
    )


def verdicts(profiles: DataFrame) -> DataFrame:
    """Adds is_agency and agency_reason; the name decides first, then the pattern of behaviour."""
    named, public = F.col("name").rlike(rx(V.AGENCY_NAME)), F.col("name").rlike(rx(V.PUBLIC_EMPLOYER))
    reason = (
        F.when(named, V.AGENCY_REASONS["name"]).when(public, V.AGENCY_REASONS["public"]).when(F.col("declared_agency"), V.AGENCY_REASONS["declared"])
        .when(matches_pattern(), F.format_string(V.AGENCY_REASONS["pattern"], "codes", "ads", "cities", "spread_km"))
        .otherwise("")
    )
    agency = named | (~public & (F.col("declared_agency") | matches_pattern()))
    return profiles.withColumn("is_agency", F.coalesce(agency, F.lit(False))).withColumn("agency_reason", reason)


def annotate_jobs(jobs: DataFrame) -> DataFrame:
    """The verdict of its company on every row, over the source's own flag."""
    facts = verdicts(company_profiles(jobs)).select("company_key", F.col("is_agency").alias("__agency"), F.col("agency_reason").alias("__reason"))
    keyed = jobs.withColumn("company_key", normalize_company(F.col("company_name")))
    done = annotate(keyed, facts, "company_key").withColumn("company_is_agency", F.coalesce("__agency", "company_is_agency")).withColumn("agency_reason", F.coalesce("__reason", F.lit("")))
    return done.drop("__agency", "__reason")


def agency_summary(jobs: DataFrame) -> DataFrame:
    """Rows by signal (the reason up to its colon)."""
    return jobs.where("company_is_agency").groupBy(F.split("agency_reason", ":")[0].alias("signal")).agg(F.count(F.lit(1)).alias("ads"))
