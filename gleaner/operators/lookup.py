"""Lookup joins: coordinates in three tiers, and per-group facts put back on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import fits_broadcast


def _dim(df: DataFrame) -> DataFrame:
    """Marks a dimension for broadcast if it is provably small, in rows and bytes."""
    return F.broadcast(df) if fits_broadcast(df) else df


def geocode(df: DataFrame, places: DataFrame) -> DataFrame:
    """Fills missing lat, lon and canton from places(postal_code, city, canton, lat, lon).

    Tiers: (postal code, city), then postal code, then city; the first tier with a hit decides, and all
    three values come from it. Where a tier has several rows the first by (postal code, city) counts.
    Rows that have coordinates keep them; `geo_tier` tells which tier hit (null: none).
    """
    p = places.select("postal_code", F.lower("city").alias("city"), F.struct("postal_code", F.lower("city").alias("city"), "lat", "lon", "canton").alias("hit"))
    exact = p.where(F.col("postal_code").isNotNull() & F.col("city").isNotNull()).groupBy("postal_code", "city").agg(F.min("hit").alias("h1"))
    by_code = p.where(F.col("postal_code").isNotNull()).groupBy("postal_code").agg(F.min("hit").alias("h2"))
    by_city = p.where(F.col("city").isNotNull()).groupBy("city").agg(F.min("hit").alias("h3"))
    keyed = df.withColumn("__city", F.lower("city"))
    joined = (
        keyed.join(_dim(exact.withColumnRenamed("city", "__city")), ["postal_code", "__city"], "left")
        .join(_dim(by_code), "postal_code", "left")
        .join(_dim(by_city.withColumnRenamed("city", "__city")), "__city", "left")
    )
    hit = F.coalesce("h1", "h2", "h3")
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    tier = F.when(F.col("h1").isNotNull(), 1).when(F.col("h2").isNotNull(), 2).when(F.col("h3").isNotNull(), 3)
    out = {"lat": F.when(missing, hit["lat"]).otherwise(F.col("lat")), "lon": F.when(missing, hit["lon"]).otherwise(F.col("lon")), "canton": F.coalesce(F.col("canton"), hit["canton"]), "geo_tier": F.when(missing, tier)}
    return joined.select(*(out.pop(c).alias(c) if c in out else F.col(c) for c in df.columns), *(v.alias(k) for k, v in list(out.items())))


def annotate(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Puts one row of facts per key back on all rows of that key."""
    return df.join(_dim(facts), key, "left")
