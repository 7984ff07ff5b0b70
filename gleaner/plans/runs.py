"""Runs over a folder of stored tables: parse, score, digest, rate, clusters, scrub, reference data, status.

Every run reads the last commit of the tables it needs and leaves new commits; each adds a row to the
run log. `python -m gleaner` calls them. What reaches the driver is a digest's top rows, one row of
counts, or a report of a few rows.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.pii import rescrub
from gleaner.functions.text import truncate
from gleaner.functions.vectors import HashingEmbedder, embed_udf
from gleaner.operators import delivery, store, terms
from gleaner.plans import pipeline
from gleaner.sources import raw, settings

JOB_KEYS = ["portal", "source_id"]
# What a later delivery may change; everything else stays as first seen.
JOB_UPDATES = [
    "title", "company_name", "description_md", "description_truncated", "city", "postal_code", "canton", "lat", "lon", "workload_min", "workload_max", "is_permanent", "start_date",
    "home_office", "expires_at", "status", "apply_url", "occupation_codes", "categories", "languages", "raw_path", "company_is_agency", "agency_reason", "description_language",
    "workload_from_title", "group_id", "group_size", "is_group_representative",
]


class Runs:
    """The runs over the tables in `folder`."""

    def __init__(self, spark: SparkSession, folder: str, *, now: datetime | None = None, embedder=None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.moment = now or datetime.now().replace(microsecond=0)
        self.now = F.lit(self.moment).cast("timestamp")
        self.embedder = embedder or HashingEmbedder()

    def table(self, name: str) -> store.Table:
        return store.Table(self.spark, f"{self.folder}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        """A stored table, or an empty one of that schema."""
        table = self.table(name)
        return table.read() if table.exists() else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        rows = rows.dropna(subset=keys)
        self.table(name).update(rows, keys, lambda old, new: store.record_entries(old, new, keys))

    def _log(self, source: str, **numbers) -> dict:
        row = store.run_log(self.spark, source, "ok", **numbers).select("source", "status", F.to_json(F.struct(*(F.col(k) for k in numbers) or [F.lit(1)])).alias("numbers"), self.now.alias("finished_at"))
        self._append("runs", row.withColumn("run_id", F.expr("uuid()")), ["run_id"])
        return numbers

    def parse(self, *, source_a: str | None = None, source_b: dict[str, str] | None = None) -> dict:
        """Raw files of both sources ({portal: folder} for B) into `jobs`; known rows are updated, none deleted."""
        parts, skipped = [], 0
        if source_a:
            files = raw.read_files(self.spark, source_a, "job_room", raw.SCHEMAS["a"])
            parts.append(raw.project_a(files, self.now))
            self._append("places", raw.locations(files), ["postal_code", "city"])
            skipped += raw.skipped_files(self.spark, source_a, raw.SCHEMAS["a"]).count()
        for portal, path in (source_b or {}).items():
            parts.append(raw.project_b(raw.read_files(self.spark, path, portal, raw.SCHEMAS["b"]), self.now))
            skipped += raw.skipped_files(self.spark, path, raw.SCHEMAS["b"]).count()
        if not parts:
            raise ValueError("no source given")
        records = parts[0]
        for p in parts[1:]:
            records = records.unionByName(p)
        places = self.read("places", "postal_code string, city string, canton string, lat double, lon double")
        done = pipeline.parse(records, places).withColumn("first_seen_at", self.now).withColumn("last_seen_at", self.now)
        jobs = self.table("jobs")
        before = jobs.read() if jobs.exists() else done.limit(0)
        counts = store.upsert_counts(before, done, JOB_KEYS).first()
        jobs.update(done, JOB_KEYS, lambda old, new: store.upsert(old, new, JOB_KEYS, [*JOB_UPDATES, "last_seen_at"]))
        due = jobs.read().where((F.col("status") == "active") & (F.col("expires_at") < self.now))
        expired = due.count()
        if expired:
            jobs.update(store.mark_expired(due, self.now), JOB_KEYS, lambda old, new: store.upsert(old, new, JOB_KEYS, ["status"]))
        return self._log("parse", new=counts["new"], updated=counts["updated"], expired=expired, skipped=skipped)

    def score(self, profile: settings.Profile) -> dict:
        """The ranking of a profile into `scores`; new vectors into `vectors`."""
        jobs = self.table("jobs").read()
        cache = self.read("vectors", "cache_key string, vector array<float>")
        ranked = pipeline.score(jobs, profile, self.now, cache=cache, embedder=self.embedder)
        keys = ["profile", "job_rowid"]
        self.table("scores").update(ranked, keys, lambda old, new: store.upsert(old, new, keys, [c for c in ranked.columns if c not in keys]))
        pool = pipeline.candidates(jobs, profile).select(pipeline.job_text(F.col("title"), F.col("company_name"), F.col("description_md")).alias("text"))
        fresh = pipeline.embed_texts(pool, cache, self.embedder).select("cache_key", "vector").dropDuplicates(["cache_key"])
        self._append("vectors", fresh, ["cache_key"])
        return self._log("score", scored=ranked.count())

    def digest(self, profile: str, out: str, *, fmt: str = "md", top: int = 15, cap: int = 3) -> str:
        """The best of a profile to a file; what was shown is recorded."""
        scores = self.table("scores").read().where(F.col("profile") == profile)
        seen = self.read("digest_seen", "profile string, job_rowid bigint, first_shown_at timestamp")
        entries = delivery.digest(scores, self.table("jobs").read(), seen, top=top, cap=cap)
        rows = entries.orderBy("position").collect()  # at most `top`
        path = delivery.write_digest([r.asDict() for r in rows], profile, out, fmt=fmt, when=self.moment)
        shown, run = delivery.record_digest(self.spark.createDataFrame(rows, entries.schema), self.now)
        self._append("digest_seen", shown, ["profile", "job_rowid"])
        self._append("digest_runs", run.withColumn("path", F.lit(path)), ["profile", "created_at"])
        self._log("digest", shown=len(rows), fresh=sum(r["is_new"] for r in rows))
        return path

    def daily(self, profiles: list[settings.Profile], out: str, **sources) -> list[str]:
        """Parse, then score and digest for every profile."""
        self.parse(**sources)
        paths = []
        for p in profiles:
            self.score(p)
            paths.append(self.digest(p.name, out))
        return paths

    def rate(self, profile: str, job: int, rating: int, reason: str | None = None, note: str | None = None) -> None:
        """One rating; a later one of the same job replaces it."""
        if rating not in delivery.RATING_LABELS:
            raise ValueError(f"a rating is one of {sorted(delivery.RATING_LABELS)}")
        if reason is not None and reason not in delivery.REJECT_REASONS:
            raise ValueError(f"a reason is one of {sorted(delivery.REJECT_REASONS)}")
        seen = self.read("scores", "profile string, job_rowid bigint, final_score double").where((F.col("profile") == profile) & (F.col("job_rowid") == job)).agg(F.max("final_score")).first()[0]
        row = self.spark.createDataFrame([(profile, job, rating, reason, note, seen)], "profile string, job_rowid bigint, rating int, reason string, note string, score_seen double").withColumn("created_at", self.now)
        keys = ["profile", "job_rowid"]
        self.table("feedback").update(row, keys, lambda old, new: store.upsert(old, new, keys, ["rating", "reason", "note", "score_seen", "created_at"]))

    def clusters(self, *, min_size: int = 25) -> DataFrame:
        """(label, name, size): clusters of the active representatives by their texts, named by field and terms."""
        jobs = self.table("jobs").read().where((F.col("status") == "active") & F.col("is_group_representative"))
        text = truncate(pipeline.job_text(F.col("title"), F.col("company_name"), F.col("description_md")))
        vectors = jobs.select("id", "title", "description_md", embed_udf(self.embedder)(text).alias("v"))
        labelled = vectors.join(terms.vector_clusters(vectors, key="id", vector="v", min_size=min_size), "id")
        found = labelled.where("label >= 0")
        words = terms.characteristic_terms(labelled.withColumn("label", F.when(F.col("label") >= 0, F.col("label"))), group="label", text="description_md")
        words = words.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("words"))  # a few per cluster
        taxonomy = self.read("taxonomy", "title string, berufsfeld string").select("title", F.col("berufsfeld").alias("field"))
        fields = terms.label_clusters(found.select(F.col("label").alias("cluster"), "title"), taxonomy, self.embedder)
        sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        named = sizes.join(words, "label", "left").join(fields.withColumnRenamed("cluster", "label"), "label", "left")
        return named.select("label", terms.cluster_name(F.col("label"), F.col("field"), F.col("words")).alias("name"), "size").orderBy(F.desc("size"), "label")

    def scrub_raw(self, path: str, out: str | None = None) -> DataFrame | None:
        """The raw cache scrubbed again by the present rules, into `out`; without `out` what would change."""
        cache = raw.read_raw(self.spark, path)
        if out is None:
            return rescrub(cache, "json", check=True)
        raw.write_raw(rescrub(cache, "json"), out)
        return None

    def import_reference(self, *, taxonomy: str | None = None, places: DataFrame | None = None) -> None:
        """Reference tables, replaced as a whole."""
        if taxonomy:
            self.table("taxonomy").replace(settings.read_taxonomy(self.spark, taxonomy).select("title", "berufsfeld"))
        if places is not None:
            self.table("places").replace(places, ["postal_code", "city"], n_buckets=8)

    def status(self, raw_path: str | None = None) -> dict:
        """Rows of every table, the last runs, and the extent of the raw cache."""
        names = ("jobs", "scores", "feedback", "vectors", "digest_seen", "digest_runs", "places", "taxonomy")
        out: dict = {n: self.table(n).read().count() for n in names if self.table(n).exists()}
        runs = self.read("runs", "source string, status string, numbers string, finished_at timestamp, run_id string")
        out["runs"] = [r.asDict() for r in store.last_runs(runs).select("source", "status", "numbers", "finished_at").collect()]  # ten
        if raw_path and os.path.isdir(raw_path):
            out["raw"] = store.cache_report(self.spark, raw_path).first().asDict()
        return out
