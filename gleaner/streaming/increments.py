"""Increments as streams: new files in, seen-set and tables brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import store


def file_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream over the files of a folder; `max_files` is the budget of each micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def first_seen(stream: DataFrame, keys: list[str], moment: str, late: str | None = "7 days") -> DataFrame:
    """Each key once, at its first arrival.

    State older than the watermark is dropped, so a key may come again after `late`. With `late` None keys are
    never forgotten; for a seen-set of any size use `keep_seen_set`, whose state is a table.
    """
    if late is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, moment: str, group: str, *, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(moment, late).groupBy(F.window(moment, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))


def _into(stream: DataFrame, target: str, keys: list[str], merge, checkpoint: str, n_buckets: int):
    """Each micro-batch into the table at `target`, once: a batch that is run again after a crash changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        table = store.Table(batch.sparkSession, target)
        table.update(batch.dropDuplicates(keys), keys, merge, n_buckets=n_buckets, writer=checkpoint, batch=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_seen_set(stream: DataFrame, target: str, keys: list[str], checkpoint: str, *, seed: bool = False, n_buckets: int = 64):
    """Brings the seen-set at `target` up to date; known keys keep what was first recorded.

    With `seed` only the keys are recorded and count as fetched, so that a first run over an old
    source leaves nothing pending.
    """
    if seed:
        stream = stream.select(*(F.col(c) if c in keys else F.current_timestamp().alias(c) if c == "fetched_at" else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes))
    return _into(stream, target, keys, lambda old, new: store.record_entries(old, new, keys), checkpoint, n_buckets)


def keep_table(stream: DataFrame, target: str, keys: list[str], updated: list[str], checkpoint: str, *, n_buckets: int = 64):
    """Upserts each micro-batch into the table at `target`: `updated` columns change, the rest is kept."""
    return _into(stream, target, keys, lambda old, new: store.upsert(old, new, keys, updated), checkpoint, n_buckets)
