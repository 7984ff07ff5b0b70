"""Sitemaps and pages that embed their data: parsing of fetched text, no network."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_MARK = "window.__PRELOADED_STATE__"


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, url, lastmod) of every <url> whose location is a job page."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return _entries(rows)


def read_sitemaps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The entries of several sitemaps in one read, each id once: that with the latest lastmod."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(list(paths))
    return _entries(rows).groupBy("source_id").agg(F.max_by(F.struct("url", "lastmod"), F.struct("lastmod", "url")).alias("e")).select("source_id", "e.*")


def parse_sitemap(texts: DataFrame, column: str = "xml") -> DataFrame:
    """The same from a column of sitemap documents."""
    block = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("b")
    rows = texts.select(block).select(
        F.trim(F.regexp_extract("b", r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("loc"),
        F.nullif(F.trim(F.regexp_extract("b", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1)), F.lit("")).alias("lastmod"),
    )
    return _entries(rows)


def _entries(rows: DataFrame) -> DataFrame:
    source_id = F.regexp_extract("loc", r"/job/[^/]+/(\d+)", 1)
    return rows.select(source_id.alias("source_id"), F.col("loc").alias("url"), F.col("lastmod").try_cast("timestamp").alias("lastmod")).where(F.col("source_id") != "")


_QUOTED_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]')


def balanced_object(text: str, start: int) -> str | None:
    """The JSON object that opens at or after `start`; strings are skipped whole."""
    open_at = text.find("{", start)
    depth = 0
    if open_at < 0:
        return None
    for m in _QUOTED_OR_BRACE.finditer(text, open_at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth == 0:
                return text[open_at : m.end()]
    return None


@F.pandas_udf(T.StringType())
def preloaded_state(s: pd.Series) -> pd.Series:
    """The JSON object a page assigns to its state variable; null if there is none or it is broken."""

    def one(page: str | None) -> str | None:
        at = (page or "").find(STATE_MARK)
        found = balanced_object(page, at) if at >= 0 else None
        try:
            json.loads(found) if found else None
        except ValueError:
            return None
        return found

    return s.map(one)


def vacancy_json(state: Column) -> Column:
    """The vacancy inside a page's state; null if absent or empty."""
    found = F.get_json_object(state, "$.vacancyDetails.data")
    return F.when(~F.coalesce(found, F.lit("{}")).isin("{}", "null", ""), found)


def looks_expired(page: Column) -> Column:
    title = F.lower(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return title.rlike("nicht mehr|abgelaufen|gone")


def route_fetches(pages: DataFrame) -> DataFrame:
    """pages(source_id, http_status, html) → adds `outcome` (gone, missing, ok), http_status and vacancy."""
    state = preloaded_state("html")
    rows = pages.withColumn("vacancy", vacancy_json(state))
    gone = F.col("http_status").isin(404, 410) | F.coalesce(looks_expired(F.col("html")), F.lit(False))
    outcome = F.when(gone, "gone").when(F.col("vacancy").isNull(), "missing").otherwise("ok")
    return rows.withColumn("outcome", outcome).withColumn("http_status", F.when(gone & ~F.col("http_status").isin(404, 410), 410).otherwise(F.col("http_status")))
