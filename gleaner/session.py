"""Session factory and the few helpers every plan needs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # those no frame refers to any more
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's `spark.checkpoint.dir`.

    Only where neither the context nor the session names one and everything runs in this process (tests, a
    laptop) a folder of our own is set, which is removed when the process ends. On a cluster a
    missing setting is an error: a folder of one machine would lose blocks with that machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data folder, narrowed to `columns` if any are given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


SPREAD = "spark.gleaner.textPartitions"


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are costly to process, read where it lies: one task per split of its files
    (`spark.sql.files.maxPartitionBytes`), never shuffled.

    A single small file is one split and keeps one core busy. For that, and only on request, the session
    setting `spark.gleaner.textPartitions` deals the rows out to so many partitions, one after the other.
    """
    df = table(spark, sf_dir, name, *columns)
    wanted = spark.conf.get(SPREAD, None)
    return df.repartition(int(wanted)) if wanted else df


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether `df` has no more than `bound` rows; reads no further than one row past the bound."""
    return df.limit(bound + 1).count() <= bound


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` is small enough for every executor, by rows and by the bytes of all its values.

    Reads no further than one row past the bound. The size is that of the rows as text, which is no
    less than what a broadcast of numbers takes, and about that of one of strings.
    """
    n, total = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n <= rows and total <= size
