"""Tables on Parquet: upserts, seen-sets, replacements, logs. No MERGE is needed.

Most functions take the stored version and the new rows and return the next version. A stored table is a
folder of numbered commits: a commit names, for each bucket of keys, the data folder that holds it.
Data are written first, the commit file appears last and in one step, and nothing that a commit
names is touched later. So a crash at any moment leaves the last commit as it was, and readers always
see one whole version. An update writes only the buckets that its keys fall into, and a batch
id that the table has seen from the same writer changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """New keys are inserted whole; of known ones only `updated` columns change, the rest stays as first seen."""
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    known, fresh = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in updated:
            cols.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return o.join(n, same, "full_outer").select(*cols)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many of the new rows' keys are new, and how many known."""
    distinct = new.select(*keys).distinct()
    return distinct.join(old.select(*keys).distinct().withColumn("__k", F.lit(1)), keys, "left").agg(
        F.count_if(F.col("__k").isNull()).alias("new"), F.count_if(F.col("__k").isNotNull()).alias("updated")
    )


def mark_expired(df: DataFrame, now: Column) -> DataFrame:
    """Active rows past their end become expired; nothing is deleted."""
    past = (F.col("status") == "active") & (F.col("expires_at") < now)
    return df.withColumn("status", F.when(F.coalesce(past, F.lit(False)), "expired").otherwise(F.col("status")))


def unseen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the seen-set, once per key."""
    return new.dropDuplicates(keys).join(seen.select(*keys).distinct(), keys, "left_anti")


def record_entries(seen: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The seen-set with the new keys added; known ones keep what was first recorded."""
    return seen.unionByName(unseen(new, seen, keys), allowMissingColumns=True)


def pending(seen: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries not fetched yet, highest numeric id first."""
    rows = seen.where(F.col("fetched_at").isNull()).orderBy(F.col("source_id").try_cast("bigint").desc_nulls_last(), F.col("source_id").desc())
    return rows.limit(limit) if limit is not None else rows


def mark_fetched(seen: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Join-update of fetched_at, http_status and raw_path."""
    return upsert(seen, results, keys, ["fetched_at", "http_status", "raw_path"]).join(seen.select(*keys), keys, "left_semi")


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key, as of an append-only table."""
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order, tie)).alias("r"))
    return kept.select("r.*")


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that `df` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """A frame in a table's current schema: missing columns null, extra ones dropped, types cast."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


class Table:
    """A stored table: `<path>/commits/<n>.json` and `<path>/data/<folder>/bucket=<b>/`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def state(self) -> dict | None:
        """The last commit: version, keys, n_buckets, buckets {number: folder}, writers {id: batch}; None if there is none."""
        folder = self._hadoop("commits")
        if not self._fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = self._fs.open(self._hadoop(f"commits/{max(numbers)}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.state() is not None

    def _read(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        folders = [f"{self.path}/data/{state['buckets'][b]}/bucket={b}" for b in buckets if b in state["buckets"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as of its last commit."""
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no commit in {self.path}")
        return self._read(state, sorted(state["buckets"]))

    def _publish(self, state: dict) -> None:
        """The commit appears by one rename, which fails if another writer was faster."""
        self._fs.mkdirs(self._hadoop("commits"))
        draft = self._hadoop(f"commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._hadoop(f"commits/{state['version']}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} of {self.path} was written by someone else")

    def _write(self, rows: DataFrame, keys: list[str], n: int) -> tuple[str, list[str]]:
        folder = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)) if keys else F.lit(0)
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"data/{folder}"))]
        return folder, [x.partition("=")[2] for x in found if x.startswith("bucket=")]

    def replace(self, rows: DataFrame, keys: list[str] | None = None, *, n_buckets: int = 1) -> None:
        """A new version with these rows alone."""
        before = self.state()
        keys = keys or []
        folder, buckets = self._write(rows, keys, n_buckets)
        version = before["version"] + 1 if before else 0
        self._publish({"version": version, "keys": keys, "n_buckets": n_buckets, "schema": rows.schema.json(), "buckets": {b: folder for b in buckets}, "writers": (before or {}).get("writers", {})})

    def update(self, new: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], *, n_buckets: int = 64, writer: str | None = None, batch: int | None = None) -> bool:
        """`merge(old, new)` for the buckets that the keys of `new` fall into; the others are not read or written.

        The number of buckets is that of the table's first version (for 100 TB choose about one for every
        GB). With `writer` and `batch`, a batch up to the last one of that writer is left out. Whether
        a version was written.
        """
        from gleaner.session import cut

        state = self.state() or {"version": -1, "keys": keys, "n_buckets": n_buckets, "schema": None, "buckets": {}, "writers": {}}
        if writer is not None and batch is not None and state["writers"].get(writer, -1) >= batch:
            return False
        n = state["n_buckets"] if state["buckets"] else n_buckets
        fresh = cut(new)
        touched = [str(r[0]) for r in fresh.select(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("b")).distinct().collect()]  # at most n
        old = self._read(state, touched) if state["schema"] else fresh.limit(0)
        merged = merge(old, fresh)
        folder, buckets = self._write(merged, keys, n)
        kept = {b: f for b, f in state["buckets"].items() if b not in touched}
        writers = state["writers"] | ({writer: batch} if writer is not None and batch is not None else {})
        self._publish({"version": state["version"] + 1, "keys": keys, "n_buckets": n, "schema": merged.schema.json(), "buckets": kept | {b: folder for b in buckets}, "writers": writers})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Removes data folders that none of the last `keep` commits names, and older commits; how many folders went.

        Not to be run while a writer is at work: what it has not committed yet is named nowhere.
        """
        last = (self.state() or {"version": -1})["version"]
        named: set[str] = set()
        for f in self._fs.listStatus(self._hadoop("commits")) if last >= 0 else []:
            name = f.getPath().getName()
            if not name[:-5].isdigit() or int(name[:-5]) <= last - keep:
                self._fs.delete(f.getPath(), False)
                continue
            stream = self._fs.open(f.getPath())
            named |= set(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"].values())
            stream.close()
        stale = [f.getPath() for f in self._fs.listStatus(self._hadoop("data")) if f.getPath().getName() not in named] if last >= 0 else []
        for folder in stale:
            self._fs.delete(folder, True)
        return len(stale)


def commit(spark: SparkSession, df: DataFrame, path: str) -> None:
    """A new whole version of the table at `path`."""
    Table(spark, path).replace(df)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path` as of its last commit."""
    return Table(spark, path).read()


def run_log(spark: SparkSession, source: str, status: str, **numbers) -> DataFrame:
    """One row of the append-only run log."""
    row = {"source": source, "status": status, "params": numbers.pop("params", None), "error": numbers.pop("error", None), **{k: int(v) for k, v in numbers.items()}}
    schema = "source string, status string, params string, error string" + "".join(f", {k} long" for k in row if k not in ("source", "status", "params", "error"))
    return spark.createDataFrame([tuple(row.values())], schema).withColumn("finished_at", F.current_timestamp())


def last_runs(log: DataFrame, limit: int = 10) -> DataFrame:
    """The latest rows of a run log."""
    return log.orderBy(F.col("finished_at").desc()).limit(limit)


def cache_report(spark: SparkSession, path: str, pattern: str = "*.gz") -> DataFrame:
    """One row on the raw cache: files, megabytes, and days (folders named by a date); from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    day = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return files.agg(F.count(F.lit(1)).alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1e6, 1).alias("mb"), F.count_distinct(F.nullif(day, F.lit(""))).alias("days"))
