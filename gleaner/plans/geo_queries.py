"""Queries on positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.geo import meant_position
from gleaner.operators.spatial import points_within
from gleaner.session import table

# The country with a margin: lowest and highest latitude, lowest and highest longitude.
COUNTRY_BOX = (45.7, 47.95, 5.8, 10.7)
NEAR_KM = 3.0


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes with a point at most 3.0 km from a posting's position."""
    lat, lon = meant_position(F.col("lat"), F.col("lon"), COUNTRY_BOX)
    jobs = table(spark, sf_dir, "jobs", "id", "lat", "lon").select("id", lat.alias("lat"), lon.alias("lon"))
    codes = table(spark, sf_dir, "plz_coords", "postal_code", "lat", "lon")
    return points_within(jobs, codes, NEAR_KM, center=("postal_code", "lat", "lon"), out=("id", "postal_code"))


P7_FOUND_SQL = """
WITH j AS (
  SELECT id,
         CASE WHEN lat BETWEEN 45.7 AND 47.95 AND lon BETWEEN 5.8 AND 10.7 THEN lat
              WHEN lon BETWEEN 45.7 AND 47.95 AND lat BETWEEN 5.8 AND 10.7 THEN lon END AS la,
         CASE WHEN lat BETWEEN 45.7 AND 47.95 AND lon BETWEEN 5.8 AND 10.7 THEN lon
              WHEN lon BETWEEN 45.7 AND 47.95 AND lat BETWEEN 5.8 AND 10.7 THEN lat END AS lo
  FROM jobs
)
SELECT DISTINCT j.id AS id, p.postal_code AS postal_code
FROM j JOIN plz_coords p
  ON abs(j.la - p.lat) < 0.03
 AND 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - j.la) / 2), 2)
       + cos(radians(j.la)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - j.lo) / 2), 2)))) <= 3.0
"""
