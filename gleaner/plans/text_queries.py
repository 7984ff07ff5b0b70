"""Queries on texts, keys and casts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import cast, language, pii, text
from gleaner.functions import fixed_values as V
from gleaner.operators import requirements, terms
from gleaner.operators.dedup import exact_groups, near_merges, with_keys
from gleaner.session import texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = r"\p{L}\p{N}_"  # what \w means in every query's SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks -------------------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


_UNESCAPE = r"regexp_replace({c}, '\\([\\`*_{{}}\[\]()#+\-.!|>~&])', '\1', 'g')"
_LEGAL_SQL = _q("(?i)" + V.LEGAL_FORM)


def _company(c: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace({c}, {_LEGAL_SQL}, ' ', 'g'), '[^{W}\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


_GENDER = _q(r"(?i)([" + W + r"])[*/:_·]-?in(?:nen)?\b")
_NOISE = _q("(?i)" + V.TITLE_NOISE)
_TAIL = _q("(?i)" + V.TITLE_TAIL)


def _title(c: str, city: str) -> str:
    t = f"replace(replace(regexp_replace(regexp_replace({c}, {_GENDER}, '\\1', 'g'), {_NOISE}, ' ', 'g'), '*', ''), '(in)', '')"
    for _ in range(3):
        t = f"regexp_replace({t}, {_TAIL}, '', 'g')"
    t = f"CASE WHEN coalesce({city}, '') <> '' THEN regexp_replace({t}, '(?i)\\b' || regexp_escape({city}) || '\\b', ' ', 'g') ELSE {t} END"
    return f"lower(trim(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' -–—,;'))"


def _hits(lang: str, c: str = "text") -> str:
    words = ", ".join(_q(w) for w in V.STOP_WORDS[lang].split())
    return f"len(list_filter(regexp_extract_all(lower(substr({c}, 1, {V.LANGUAGE_SAMPLE_CHARS})), '[a-zà-öø-ÿ]+'), lambda w: w IN ({words})))"


_DETECT = f"""
SELECT *, CASE WHEN m >= {V.LANGUAGE_MIN_HITS} AND (s = 0 OR m >= s * {V.LANGUAGE_MIN_RATIO})
               THEN CASE m WHEN de THEN 'de' WHEN fr THEN 'fr' WHEN it THEN 'it' ELSE 'en' END END AS detected
FROM (SELECT *, greatest(de, fr, it, en) AS m, list_sort([de, fr, it, en])[3] AS s
      FROM (SELECT *, {_hits('de')} AS de, {_hits('fr')} AS fr, {_hits('it')} AS it, {_hits('en')} AS en FROM documents WHERE text IS NOT NULL))
"""


# --- languages -----------------------------------------------------------------------------------
@query(f"SELECT lang AS declared, detected, count(*) AS n FROM ({_DETECT}) GROUP BY ALL")
def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by stop words against the declared one."""
    docs = texts(spark, sf_dir, "documents", "text", "lang").where(F.col("text").isNotNull())
    return docs.select(F.col("lang").alias("declared"), language.detect_language(F.col("text")).alias("detected")).groupBy("declared", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id FROM ({_DETECT}) WHERE detected IS NULL OR detected IN ('de', 'it')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a wanted language; unknown languages pass."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return docs.where(language.matches_language(language.detect_language(F.col("text")), ["de", "it"])).select("doc_id")


# --- cleaning --------------------------------------------------------------------------------------
@query(
    "SELECT id, md5(regexp_replace(regexp_replace(description_md, '(?i)[" + W + r".+-]+@[" + W + r"-]+\.[" + W + r".]{2,}', '[E-Mail entfernt]', 'g'), "
    + _q("(?i)" + V.PHONE) + ", '[Telefon entfernt]', 'g')) AS redacted FROM jobs WHERE description_md IS NOT NULL"
)
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes and phone numbers replaced."""
    jobs = texts(spark, sf_dir, "jobs", "id", "description_md").where(F.col("description_md").isNotNull())
    return jobs.select("id", F.md5(pii.redact_text(F.col("description_md"))).alias("redacted"))


@query(f"SELECT DISTINCT id, md5({_strip('activity')}) AS stripped, md5({_UNESCAPE.format(c='requirements')}) AS unescaped FROM ch_media_vacancies")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags stripped; Markdown escapes removed (F1, F2)."""
    rows = texts(spark, sf_dir, "ch_media_vacancies", "id", "activity", "requirements")
    return rows.select("id", F.md5(text.strip_html(F.col("activity"))).alias("stripped"), F.md5(text.unescape_markdown(F.col("requirements"))).alias("unescaped")).distinct()


@query(
    f"""
SELECT id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(
         CASE WHEN length(regexp_extract(substr(t, 1, 260), '(?s)^(.*)\\s\\S*$', 1)) > 156 THEN regexp_extract(substr(t, 1, 260), '(?s)^(.*)\\s\\S*$', 1) ELSE substr(t, 1, 260) END,
         ' ,;.') || ' …' END AS snippet
FROM (SELECT id, {_UNESCAPE.format(c=_strip('description_md'))} AS t FROM jobs)
"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the stripped texts, cut at a space."""
    return texts(spark, sf_dir, "jobs", "id", "description_md").select("id", text.snippet(F.col("description_md")).alias("snippet"))


@query(
    """
SELECT id, CASE WHEN length(t) <= 90 THEN t ELSE rtrim(substr(t, 1, 89)) || '…' END AS short, substr(trim(coalesce(description_md, '')), 1, 6000) = trim(coalesce(description_md, '')) AS whole
FROM (SELECT id, description_md, trim(regexp_replace(translate(""" + _UNESCAPE.format(c="coalesce(description_md, '')") + """, '|', '/'), '[\\s\\x{00a0}]+', ' ', 'g')) AS t FROM jobs)
"""
)
def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per text for a table cell; whether the embedding limit cuts it."""
    jobs = texts(spark, sf_dir, "jobs", "id", "description_md")
    d = F.col("description_md")
    return jobs.select("id", text.short(d).alias("short"), (text.truncate(d) == F.trim(F.coalesce(d, F.lit("")))).alias("whole"))


def _section(pattern: str) -> str:
    """A line pattern of sections as RE2 reads it: \\w and \\s as in every query, with no-break spaces."""
    p = pattern.replace(r"[*#_\\\s]", "[*#_\\\\~]").replace(r"\s", "[\\s\u00a0]").replace("~", "\\s\u00a0").replace(r"\w", f"[{W}]")
    return _q("(?i)" + p)


@query(
    f"""
WITH k AS (SELECT id, title, company_name, description_md AS d, s, list_transform(s, lambda x: CASE WHEN regexp_matches(x, {_section(V.SECTION_START)}) THEN 1 WHEN regexp_matches(x, {_section(V.SECTION_END)}) THEN 2 ELSE 0 END) AS kinds
           FROM (SELECT *, string_split(description_md, chr(10)) AS s FROM jobs)),
     p AS (SELECT *, coalesce(list_position(kinds, 1), 0) AS f, list_max(list_transform(range(1, len(kinds) + 1), lambda i: CASE WHEN kinds[i] = 1 THEN i ELSE 0 END)) AS last FROM k),
     q AS (SELECT *, coalesce(list_position(kinds[last + 1 :], 2), 0) AS after FROM p),
     r AS (SELECT *, trim(array_to_string(s[f : CASE WHEN after > 0 THEN last + after - 1 ELSE len(s) END], chr(10))) AS part FROM q),
     t AS (SELECT id, title, company_name, CASE WHEN f > 0 AND part <> '' THEN part ELSE d END AS kept FROM r)
SELECT id, length(kept) AS kept, length(concat_ws(chr(10) || chr(10), title, title || ' bei ' || company_name || '.', nullif(substr({_strip('kept')}, 1, 2500), ''))) AS embedded FROM t
"""
)
def relevant_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task and requirement sections, and the text to embed."""
    jobs = texts(spark, sf_dir, "jobs", "id", "title", "company_name", "description_md")
    return jobs.select("id", F.length(text.extract_relevant(F.col("description_md"))).alias("kept"), F.length(text.job_text(F.col("title"), F.col("company_name"), F.col("description_md"))).alias("embedded"))


# --- keys ------------------------------------------------------------------------------------------
@query(f"SELECT id, {_title('title', 'city')} AS title_key, {_company('company_name')} AS company_key FROM jobs")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable titles and company names."""
    jobs = texts(spark, sf_dir, "jobs", "id", "title", "city", "company_name")
    return jobs.select("id", text.normalize_title(F.col("title"), F.col("city")).alias("title_key"), text.normalize_company(F.col("company_name")).alias("company_key"))


_HASH = f"substr(sha256(coalesce({_title('title', 'city')}, '') || '|' || lower({_strip('description_md')})), 1, 32)"


@query(f"SELECT h AS content_hash, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_HASH} AS h FROM jobs) GROUP BY h HAVING count(*) > 1")
def content_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal content hashes."""
    keyed = with_keys(texts(spark, sf_dir, "jobs", "id", "title", "city", "company_name", "description_md", "postal_code", "portal"))
    return keyed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(
    f"""
WITH k AS (SELECT id, source_id, {_title('title', 'city')} AS t, {_company('company_name')} AS c, {_HASH} AS h,
                  CASE portal WHEN 'job_room' THEN 0 WHEN 'myjob' THEN 1 WHEN 'ostjob' THEN 2 WHEN 'zentraljob' THEN 3 ELSE 99 END AS r FROM jobs)
SELECT id, substr(first_value(h) OVER w, 1, 16) AS group_id, count(*) OVER (PARTITION BY c, t) AS group_size, id = first_value(id) OVER w AS is_group_representative
FROM k WINDOW w AS (PARTITION BY c, t ORDER BY r, source_id, id)
"""
)
def company_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal company and title, with their heads."""
    return exact_groups(texts(spark, sf_dir, "jobs", "id", "source_id", "portal", "title", "city", "company_name", "description_md", "postal_code"))


@query()
def company_near_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group heads within a company."""
    jobs = texts(spark, sf_dir, "jobs", "id", "source_id", "portal", "title", "city", "company_name", "description_md", "postal_code")
    heads = exact_groups(jobs).where("is_group_representative").select("id")
    keyed = jobs.select("id", text.normalize_company(F.col("company_name")).alias("company_key"), "description_md")
    return near_merges(keyed.join(heads, "id"))


@query(
    f"""
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1
                    ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS shingles
FROM (SELECT doc_id, list_filter(string_split(lower({_strip('text')}), ' '), lambda x: x <> '') AS w FROM documents)
"""
)
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct five-word shingles of every document."""
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(text.shingles(F.col("text"))).cast("long").alias("shingles"))


@query(
    r"""
SELECT id, CASE WHEN coalesce(regexp_extract(apply_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') = '' THEN NULL
  ELSE regexp_replace(lower(regexp_extract(apply_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')
    || lower(regexp_replace(regexp_extract(apply_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')) END AS url_key
FROM jobs
"""
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of application URLs, without tracking."""
    return texts(spark, sf_dir, "jobs", "id", "apply_url").select("id", text.url_key(F.col("apply_url")).alias("url_key"))


@query("SELECT coalesce(nullif(postal_code, ''), nullif(lower(city), ''), '?') AS block, count(*) AS n FROM jobs GROUP BY ALL")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the blocks that records are compared in (1.4)."""
    return texts(spark, sf_dir, "jobs", "postal_code", "city").groupBy(text.dedup_block(F.col("postal_code"), F.col("city")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


# --- casts, workloads, dates ---------------------------------------------------------------------
_WL = r"\b(\d{1,3})\s*(?:[–\-—]\s*(\d{1,3})\s*)?%"


@query(
    rf"""
SELECT id, CASE WHEN r THEN a ELSE workload_min END AS lo, CASE WHEN r THEN b ELSE workload_max END AS hi, r AS from_title,
       CASE WHEN workload_min IS NULL AND workload_max IS NULL THEN 'offen'
            WHEN workload_min IS NULL OR workload_max IS NULL THEN coalesce(workload_min, workload_max)::VARCHAR || '%'
            WHEN workload_min = workload_max THEN workload_min::VARCHAR || '%' ELSE workload_min::VARCHAR || '-' || workload_max::VARCHAR || '%' END AS label
FROM (SELECT *, coalesce(workload_min IS NOT NULL AND workload_max IS NOT NULL AND a <= b AND a BETWEEN 1 AND 100 AND b BETWEEN 1 AND 100 AND NOT (workload_min <= a AND b <= workload_max), false) AS r
      FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(title, '{_WL}', 2), '') AS INT), a) AS b
            FROM (SELECT id, title, workload_min, workload_max, try_cast(nullif(regexp_extract(title, '{_WL}', 1), '') AS INT) AS a FROM jobs)))
"""
)
def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workloads reconciled with titles, and their labels."""
    jobs = texts(spark, sf_dir, "jobs", "id", "title", "workload_min", "workload_max")
    lo, hi, from_title = text.reconcile_workload(F.col("title"), F.col("workload_min"), F.col("workload_max"))
    return jobs.select("id", lo.alias("lo"), hi.alias("hi"), from_title.alias("from_title"), text.workload_label(F.col("workload_min"), F.col("workload_max")).alias("label"))


@query(
    """
SELECT DISTINCT id, coalesce(try_cast(date_actualization AS TIMESTAMP), try_cast(substr(date_actualization, 1, 10) AS TIMESTAMP)) AS actual,
       coalesce(try_cast(date_start AS TIMESTAMP), try_cast(substr(date_start, 1, 10) AS TIMESTAMP)) AS start,
       try_cast(trunc(try_cast(workplace_zip AS DOUBLE)) AS INT) AS zip
FROM ch_media_vacancies
"""
)
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with and without time, numbers from text."""
    rows = texts(spark, sf_dir, "ch_media_vacancies", "id", "date_actualization", "date_start", "workplace_zip")
    moment = lambda c: cast.to_datetime(F.col(c)).cast("timestamp_ntz")
    return rows.select("id", moment("date_actualization").alias("actual"), moment("date_start").alias("start"), cast.to_int(F.col("workplace_zip")).alias("zip")).distinct()


@query(
    """
SELECT id, greatest(0, floor((epoch(expires_at) - epoch(TIMESTAMP '2025-09-01 00:00:00')) / 86400))::BIGINT AS days_left,
       ['Montag', 'Dienstag', 'Mittwoch', 'Donnerstag', 'Freitag', 'Samstag', 'Sonntag'][isodow(posted_at)] || ', ' || strftime(posted_at, '%d.%m.%Y') AS posted
FROM jobs WHERE expires_at IS NOT NULL AND posted_at IS NOT NULL
"""
)
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days left at a fixed moment; German dates."""
    jobs = texts(spark, sf_dir, "jobs", "id", "expires_at", "posted_at").where("expires_at IS NOT NULL AND posted_at IS NOT NULL")
    now = F.lit("2025-09-01 00:00:00").cast("timestamp")
    return jobs.select("id", cast.expires_in_days(F.col("expires_at"), now).cast("long").alias("days_left"), text.date_label(F.col("posted_at")).alias("posted"))


# --- requirement levels, terms, skills -----------------------------------------------------------
def _w(p: str) -> str:
    return p.replace(r"\w", f"[{W}]")


@query(
    f"""
SELECT id, regexp_matches(title, {_q('(?i)' + _w(V.LEADERSHIP_TITLE))}) AS leadership,
       regexp_matches(title, {_q('(?i)' + _w(V.SENIOR_TITLE))}) AND NOT regexp_matches(title, {_q('(?i)' + V.JUNIOR_TITLE)}) AS senior
FROM jobs
"""
)
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leadership and senior titles."""
    return texts(spark, sf_dir, "jobs", "id", "title").select("id", requirements.is_leadership(F.col("title")).alias("leadership"), requirements.is_senior(F.col("title")).alias("senior"))


@query()
def requirement_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education, years, languages demanded."""
    jobs = texts(spark, sf_dir, "jobs", "id", "title", "description_md")
    return jobs.select("id", requirements.requirements(F.col("title"), F.col("description_md")).alias("r")).select("id", "r.*")


_TERM_STOP = ", ".join(_q(w) for w in sorted(set(V.TERM_STOP_WORDS)))


@query(
    f"""
WITH d AS (SELECT lang AS g, list_filter(list_distinct(regexp_extract_all(lower({_strip('text')}), '[a-zäöüß]{{4,}}')), lambda w: w NOT IN ({_TERM_STOP})) AS w FROM documents),
     t AS (SELECT g, unnest(w) AS term FROM d), b AS (SELECT g, term, count(*) AS df FROM t GROUP BY ALL),
     a AS (SELECT term, sum(df) AS df_all FROM b GROUP BY term), n AS (SELECT g, count(*) AS n FROM d WHERE g IS NOT NULL GROUP BY g)
SELECT g AS lang, term, df, position FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS position FROM (
    SELECT b.g, b.term, b.df, (b.df / n.n) * ln((b.df / n.n) / (a.df_all / (SELECT count(*) FROM d)) + 1e-9) AS score
    FROM b JOIN n ON b.g = n.g JOIN a ON a.term = b.term WHERE b.df >= greatest(3, floor(n.n * 0.10))) WHERE score > 0) WHERE position <= 6
"""
)
def terms_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characteristic terms of each declared language."""
    found = terms.characteristic_terms(texts(spark, sf_dir, "documents", "text", "lang"), group="lang", text="text")
    return found.select("lang", "term", "df", F.col("position").cast("long").alias("position"))


SKILLS = {"Python": [], "SQL": [], "Excel": [], "Linux": [], "CAD": [], "HACCP": [], "Englisch": ["English"], "Schweissen": [], "Staplerausweis": []}


def _skill_sql(names: list[str]) -> str:
    return _q(f"(?i)(^|[^{W}])(?:" + "|".join(sorted(names, key=len, reverse=True)) + f")($|[^{W}])")


@query(
    "WITH d AS (SELECT lang AS g, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches({_strip('text')}, {_skill_sql([k, *v])}) THEN '{k}' END" for k, v in SKILLS.items())
    + """], lambda x: x IS NOT NULL) AS s FROM documents WHERE lang IS NOT NULL),
n AS (SELECT g, count(*) AS n FROM d GROUP BY g)
SELECT lang, skill, demand, share, own, NOT own AND share >= 0.15 AS gap FROM (
  SELECT t.g AS lang, skill, count(*) AS demand, round(count(*) / any_value(n.n), 3) AS share, skill IN ('Excel') AS own
  FROM (SELECT g, unnest(s) AS skill FROM d) t JOIN n ON n.g = t.g GROUP BY t.g, skill)
"""
)
def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand for skills by language, and gaps."""
    return terms.skill_demand(texts(spark, sf_dir, "documents", "text", "lang"), group="lang", text="text", skills=SKILLS, own=["Excel"])
