"""The raw cache (one gzip JSON per record, by portal and day) and the two sources' projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import fixed_values as V
from gleaner.functions.cast import first_filled, to_datetime, to_float, to_int
from gleaner.functions.text import collapse, is_truncated, safe_id
from gleaner.operators.dedup import latest_by_key


def write_raw(records: DataFrame, path: str, *, key: str = "source_id") -> None:
    """records(portal, day, <key>, json) → gzip JSON lines under portal=…/day=…"""
    records.select("portal", "day", safe_id(F.col(key)).alias("source_id"), "json").write.mode("append").partitionBy("portal", "day").option("compression", "gzip").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw cache as (portal, day, source_id, json)."""
    return spark.read.schema("source_id string, json string, portal string, day date").option("ignoreCorruptFiles", True).json(path)


def _documents(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    return text.select(F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"), F.col("_metadata.file_path").alias("raw_path"))


def read_files(spark: SparkSession, path: str, portal: str, schema: str, pattern: str = "*.json.gz") -> DataFrame:
    """One JSON document per file, recursively; unreadable files and broken documents are dropped.

    Adds `raw_path` and `portal`. `skipped_files` lists what is dropped.
    """
    parsed = _documents(spark, path, schema, pattern)
    return parsed.where(F.col("r").isNotNull() & F.col("r._broken").isNull()).select("r.*", "raw_path", F.lit(portal).alias("portal")).drop("_broken")


def skipped_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.json.gz") -> DataFrame:
    """(raw_path, reason) of the files that `read_files` drops: 'unreadable' or 'broken'; for the run's log."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("raw_path"))
    seen = _documents(spark, path, schema, pattern).select("raw_path", (F.col("r").isNull() | F.col("r._broken").isNotNull()).alias("broken"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731 - the two readers spell local paths differently
    both = listed.withColumn("k", plain("raw_path")).join(seen.select(plain("raw_path").alias("k"), "broken"), "k", "left")
    return both.where(F.coalesce("broken", F.lit(True))).select("raw_path", F.when(F.col("broken").isNull(), "unreadable").otherwise("broken").alias("reason"))


def write_pages(pages: DataFrame, path: str) -> None:
    """pages(portal, day, html) → text files under portal=…/day=…"""
    pages.select("portal", "day", F.col("html").alias("value")).write.mode("append").partitionBy("portal", "day").text(path)


def last_path_wins(df: DataFrame) -> DataFrame:
    """One record per (portal, source_id): that of the last path."""
    return latest_by_key(df, ["portal", "source_id"], ["raw_path"])


def picked_description(descriptions: Column) -> Column:
    """The first German description, else the first."""
    german = F.filter(descriptions, lambda d: F.lower(d["languageIsoCode"]) == "de")
    return F.coalesce(F.get(german, F.lit(0)), F.get(descriptions, F.lit(0)))


def project_a(raw: DataFrame, now: Column) -> DataFrame:
    """Nested search records in canonical form; without id, title or company they are dropped."""
    c, e, loc = F.col("jobContent"), F.col("jobContent.employment"), F.col("jobContent.location")
    text = picked_description(c["jobDescriptions"])
    end = to_datetime(F.col("publication.endDate"))
    flags = c["applyChannelFlags"]
    rows = raw.select(
        F.lit("job_room").alias("portal"),
        F.col("id").alias("source_id"),
        F.concat(F.lit("https://source-a.invalid/job/"), F.col("id")).alias("source_url"),
        collapse(text["title"]).alias("title"),
        collapse(c["company"]["name"]).alias("company_name"),
        F.coalesce(c["company"]["surrogate"], F.lit(False)).alias("company_is_agency"),
        F.coalesce(text["description"], F.lit("")).alias("description_md"),
        F.lit(False).alias("description_truncated"),
        loc["city"].alias("city"), loc["postalCode"].alias("postal_code"), loc["cantonCode"].alias("canton"),
        to_float(loc["coordinates"]["lat"]).alias("lat"), to_float(loc["coordinates"]["lon"]).alias("lon"),
        to_int(e["workloadPercentageMin"]).alias("workload_min"), to_int(e["workloadPercentageMax"]).alias("workload_max"),
        e["permanent"].alias("is_permanent"),
        to_datetime(e["startDate"]).cast("date").alias("start_date"),
        F.when(F.array_contains(e["workForms"], "HOME_WORK"), True).alias("home_office"),
        F.coalesce(to_datetime(F.col("publication.startDate")), to_datetime(F.col("createdTime"))).alias("posted_at"),
        end.alias("expires_at"),
        F.when(end < now, "expired").otherwise("active").alias("status"),
        first_filled(flags["form_url"], c["externalUrl"]).alias("apply_url"),
        F.filter(F.transform(c["occupations"], lambda o: o["avamOccupationCode"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("occupation_codes"),
        F.array().cast("array<string>").alias("categories"),
        F.filter(F.transform(c["languageSkills"], lambda s: s["languageIsoCode"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("languages"),
        "raw_path",
    )
    return _valid(rows)


def project_b(raw: DataFrame, now: Column) -> DataFrame:
    """Flat vacancies in canonical form; a workload maximum below the minimum is raised to it."""
    body = F.trim(F.concat_ws("\n\n", F.nullif("activity", F.lit("")), F.nullif("requirements", F.lit(""))))
    hints = F.lit(False)
    for hint in V.AGENCY_HINTS:
        hints = hints | F.contains(F.lower(F.col("company.name")), F.lit(hint))
    rows = raw.select(
        "portal",
        F.col("id").cast("string").alias("source_id"),
        F.col("_source_url").alias("source_url"),
        collapse(F.col("title")).alias("title"),
        collapse(F.col("company.name")).alias("company_name"),
        F.coalesce(hints, F.lit(False)).alias("company_is_agency"),
        body.alias("description_md"),
        is_truncated(body, F.col("url_description"), F.col("_source_url")).alias("description_truncated"),
        F.col("workplace_city").alias("city"), F.col("workplace_zip").alias("postal_code"), F.lit(None).cast("string").alias("canton"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        to_int(F.col("type_value_min")).alias("workload_min"),
        F.greatest(to_int(F.col("type_value_max")), to_int(F.col("type_value_min"))).alias("workload_max"),
        F.lit(None).cast("boolean").alias("is_permanent"),
        to_datetime(F.col("date_start")).cast("date").alias("start_date"),
        F.col("home_office"),
        F.coalesce(to_datetime(F.col("date_first_published")), to_datetime(F.col("date_actualization"))).alias("posted_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit("active").alias("status"),
        first_filled(F.col("url_application"), F.col("url_description")).alias("apply_url"),
        F.array().cast("array<string>").alias("occupation_codes"),
        F.filter(F.transform("categories", lambda c: c["title"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("categories"),
        F.array().cast("array<string>").alias("languages"),
        (F.col("raw_path") if "raw_path" in raw.columns else F.lit(None).cast("string").alias("raw_path")),
    )
    return _valid(rows)


def _valid(rows: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in ("source_id", "title", "company_name"):
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return rows.where(ok)


def locations(raw_a: DataFrame) -> DataFrame:
    """(postal_code, city) → canton, lat, lon of the last path that names them (nested pruning applies)."""
    loc = raw_a.select("jobContent.location", "raw_path")
    rows = loc.select(
        F.col("location.postalCode").alias("postal_code"), F.col("location.city").alias("city"), F.col("location.cantonCode").alias("canton"),
        to_float(F.col("location.coordinates.lat")).alias("lat"), to_float(F.col("location.coordinates.lon")).alias("lon"), "raw_path",
    ).where(F.col("postal_code").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.groupBy("postal_code", "city").agg(F.max_by(F.struct("canton", "lat", "lon"), "raw_path").alias("l")).select("postal_code", "city", "l.canton", "l.lat", "l.lon")


SCHEMAS = {"a": schemas.SOURCE_A, "b": schemas.SOURCE_B}
