"""Ranked lists for delivery: joins with what was shown and rated, caps, deltas, reports."""

from __future__ import annotations

import html
import os
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import snippet, workload_label
from gleaner.operators.ranking import cap_per_group

# Labels of ratings, reasons, which weight a reason speaks about, and from how many ratings on.
RATING_LABELS = {1: "interessant", 0: "vielleicht", -1: "nein"}
REJECT_REASONS = {
    "ort": "zu weit weg",
    "beruf": "falscher Beruf / falsches Fachgebiet",
    "pensum": "Pensum passt nicht",
    "vermittler": "Personalvermittler",
    "senior": "Anforderungen zu hoch / zu senior",
    "junior": "zu wenig anspruchsvoll",
    "arbeitszeit": "Arbeitszeitmodell passt nicht",
    "firma": "Arbeitgeber kommt nicht in Frage",
    "anderes": "anderer Grund",
}
REASON_WEIGHTS = {"ort": "location", "beruf": "semantic", "pensum": "workload", "vermittler": "agency_penalty", "arbeitszeit": "flextime", "senior": "seniority_penalty", "junior": "keywords"}
REASON_KEYS = {"zu weit weg": "ort", "falscher Beruf": "beruf", "Pensum": "pensum", "Vermittler": "vermittler", "zu hohe Anforderungen": "senior"}
CALIBRATION_RATINGS = 40


def with_new_flag(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """`is_new`: the key isn't among those already shown."""
    shown = seen.select(*keys).distinct().withColumn("__seen", F.lit(1))
    return rows.join(shown, keys, "left").withColumn("is_new", F.col("__seen").isNull()).drop("__seen")


def group_places(jobs: DataFrame, limit: int = 8, order: str | None = None) -> DataFrame:
    """Up to `limit` cities of each group, each once, by first occurrence in `order` (default: by name).

    A city is reduced to its first row before anything of a group is collected.
    """
    named = jobs.where(F.col("group_id").isNotNull() & (F.coalesce("city", F.lit("")) != ""))
    first = named.groupBy("group_id", "city").agg((F.min(order) if order else F.min("city")).alias("at"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("at", "city"))).where(F.col("k") <= limit)
    return kept.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "city"))), lambda x: x["city"]).alias("places"))


def digest(scores: DataFrame, jobs: DataFrame, seen: DataFrame, *, top: int = 15, cap: int = 3) -> DataFrame:
    """Per profile the best `top` jobs, at most `cap` per company, with position, is_new and texts."""
    best = cap_per_group(
        scores.join(jobs.select(F.col("id").alias("job_rowid"), "company_name", "title", "workload_min", "workload_max", "description_md", "group_id"), "job_rowid").select("profile", "job_rowid", "final_score", "company_name", "title", "workload_min", "workload_max", "description_md", "group_id"),
        partition=["profile"], group="company_name", order=[F.col("final_score").desc(), F.col("job_rowid")], cap=cap, top=top,
    )
    flagged = with_new_flag(best, seen, ["profile", "job_rowid"])
    return flagged.select("profile", "position", "job_rowid", "title", "company_name", "final_score", "is_new", workload_label(F.col("workload_min"), F.col("workload_max")).alias("workload"), snippet(F.col("description_md")).alias("snippet"))


def expiring(scores: DataFrame, jobs: DataFrame, shown: DataFrame, *, now: Column, days: int = 7, pool: int = 60, top: int = 5) -> DataFrame:
    """Of each profile's best `pool` jobs those that end within `days`, not shown yet, first `top`."""
    rated = scores.select("profile", "job_rowid", "final_score")
    head = cap_per_group(rated, partition=["profile"], group="job_rowid", order=[F.col("final_score").desc(), F.col("job_rowid")], cap=1, top=pool)
    soon = head.join(jobs.select(F.col("id").alias("job_rowid"), "expires_at"), "job_rowid").where(F.col("expires_at").between(now, now + F.expr(f"INTERVAL {int(days)} DAYS")))
    fresh = soon.join(shown.select("profile", "job_rowid"), ["profile", "job_rowid"], "left_anti")
    return cap_per_group(fresh, partition=["profile"], group="job_rowid", order=[F.col("final_score").desc(), F.col("job_rowid")], cap=1, top=top)


def unrated(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """Scored jobs without a rating."""
    return scores.join(feedback.select("profile", "job_rowid"), ["profile", "job_rowid"], "left_anti")


def separation(rated: DataFrame) -> DataFrame:
    """Per profile: mean score of good minus mean score of bad ratings; null where a side is empty."""
    good, bad = F.avg(F.when(F.col("rating") == 1, F.col("score"))), F.avg(F.when(F.col("rating") == -1, F.col("score")))
    return rated.groupBy("profile").agg(F.round(good - bad, 4).alias("separation"), F.count(F.lit(1)).alias("ratings"))


def weight_suggestions(feedback: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Share of each reason (key or wording) among the rejections of a profile, and the weight it suggests."""
    no = feedback.where((F.col("rating") == -1) & F.col("reason").isNotNull())
    counts = no.groupBy("profile", "reason").agg(F.count(F.lit(1)).alias("n"))
    totals = no.groupBy("profile").agg(F.count(F.lit(1)).alias("total"))
    known = REASON_WEIGHTS | {wording: REASON_WEIGHTS[key] for wording, key in REASON_KEYS.items()}
    names = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    current = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))
    share = F.col("n") / F.col("total")
    return counts.join(totals, "profile").select("profile", "reason", "n", share.alias("share"), F.round(current[names[F.col("reason")]] * (1 + share), 2).alias("suggested"))


def record_digest(entries: DataFrame, when: Column) -> tuple[DataFrame, DataFrame]:
    """What a digest (profile, job_rowid, is_new, …) leaves behind: rows for `digest_seen` (profile, job_rowid,
    first_shown_at), to be added by `store.record_entries`, and for the log `digest_runs` (profile,
    created_at, shown, new_count, path), to be appended."""
    seen = entries.select("profile", "job_rowid", when.alias("first_shown_at")).dropDuplicates(["profile", "job_rowid"])
    runs = entries.groupBy("profile").agg(F.count(F.lit(1)).alias("shown"), F.count_if("is_new").alias("new_count"))
    return seen, runs.select("profile", when.alias("created_at"), "shown", "new_count", F.lit(None).cast("string").alias("path"))


def last_digest(runs: DataFrame) -> DataFrame:
    """The latest run of each profile."""
    return runs.groupBy("profile").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "profile")), "created_at").alias("r")).select("profile", "r.*")


def with_digest_path(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Sets the file, paths(profile, path), on the latest run of each profile; older runs keep theirs."""
    newest = runs.groupBy("profile").agg(F.max("created_at").alias("__last"))
    joined = runs.join(newest, "profile").join(paths.select("profile", F.col("path").alias("__path")), "profile", "left")
    at = (F.col("created_at") == F.col("__last")) & F.col("__path").isNotNull()
    return joined.withColumn("path", F.when(at, F.col("__path")).otherwise(F.col("path"))).drop("__last", "__path")


def digest_stats(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """(profile, digests, already_shown): numbers of runs and of jobs shown."""
    a = runs.groupBy("profile").agg(F.count(F.lit(1)).alias("digests"))
    b = seen.groupBy("profile").agg(F.count(F.lit(1)).alias("already_shown"))
    none = F.lit(0).cast("long")
    return a.join(b, "profile", "full_outer").select("profile", F.coalesce("digests", none).alias("digests"), F.coalesce("already_shown", none).alias("already_shown"))


def profiles_by_scores(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Profiles that have scores first, then by name."""
    has = scores.select("profile").distinct().withColumn("has_scores", F.lit(True))
    return profiles.join(has, "profile", "left").withColumn("has_scores", F.coalesce("has_scores", F.lit(False))).orderBy(F.col("has_scores").desc(), "profile")


def write_digest(rows: list, profile: str, folder: str, *, fmt: str = "md", when: datetime | None = None) -> str:
    """Renders a digest (already limited to its top rows) to `<date>_<profile>.<fmt>` and returns the path."""
    when = when or datetime.now()
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{when:%Y-%m-%d}_{re.sub(r'[^A-Za-z0-9_-]+', '_', profile)}.{fmt}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(rows, profile, fmt=fmt, when=when))
    return path


def render(rows: list, profile: str, *, fmt: str = "md", when: datetime | None = None) -> str:
    """A digest (already limited to its top rows) as Markdown or HTML."""
    stamp = (when or datetime.now()).strftime("%d.%m.%Y")
    if fmt == "md":
        body = "\n".join(f"{r['position']}. **{r['title']}** – {r['company_name']} ({r['workload']}){' *neu*' if r['is_new'] else ''}\n   {r['snippet']}" for r in rows)
        return f"# {profile}, {stamp}\n\n{body}\n"
    items = "".join(f"<li><b>{html.escape(r['title'] or '')}</b> – {html.escape(r['company_name'] or '')} ({html.escape(r['workload'] or '')}){' <i>neu</i>' if r['is_new'] else ''}<br>{html.escape(r['snippet'] or '')}</li>" for r in rows)
    return f"<h1>{html.escape(profile)}, {stamp}</h1><ol>{items}</ol>"
