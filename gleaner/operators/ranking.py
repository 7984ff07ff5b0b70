"""Ranks, caps, windows by hand, and lists for delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_spread(df: DataFrame, partition: list[str], value: str, tie: str, out: str = "spread") -> DataFrame:
    """Ascending stable rank / (n - 1) within a partition; a single row gets 1, null values null.

    No partition has to fit in one task (`ranked_within`); partition keys are not null. For one
    ranking over the whole table use `rank_spread_distributed`.
    """
    has = df.where(F.col(value).isNotNull())
    sizes = has.groupBy(*partition).agg(F.count(F.lit(1)).alias("__size"))
    ranked = ranked_within(has, partition, [F.col(value).asc(), F.col(tie).asc()], "__rank").join(sizes, partition)
    spread = F.when(F.col("__size") == 1, 1.0).otherwise((F.col("__rank") - 1) / (F.col("__size") - 1))
    none = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.withColumn(out, spread).drop("__rank", "__size").unionByName(none)


def rank_spread_distributed(df: DataFrame, value: str, tie: str, out: str = "spread") -> DataFrame:
    """The same over the whole table without a single-task sort: range partitions and their offsets."""
    parts = df.where(F.col(value).isNotNull()).repartitionByRange(F.col(value), F.col(tie)).withColumn("__p", F.spark_partition_id())
    from gleaner.session import cut

    parts = cut(parts)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    offsets = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(value, tie))
    ranked = parts.join(F.broadcast(offsets), "__p")
    spread = F.when(F.col("total") == 1, 1.0).otherwise((F.col("before") + local - 1) / (F.col("total") - 1))
    return ranked.withColumn(out, spread).drop("__p", "before", "total")


def ranked_within(df: DataFrame, group: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """Adds the row's rank (1, 2, …) in `order` within its group; no group has to fit in one task.

    Rows are put in range partitions of (group, order); a rank is that within the partition plus the rows
    of the group in the partitions before. `order` should be total, else ties are ranked either way.
    Groups are not null.
    """
    from gleaner.session import cut

    parts = cut(df.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("__p", F.spark_partition_id()))
    keys = ["__p", *group]
    sizes = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))  # one row per group and partition that it meets
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__p")) - F.col("__n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return parts.join(sizes.select(*keys, before.alias("__before")), keys).withColumn(out, F.col("__before") + local).drop("__p", "__before")


def cap_per_group(df: DataFrame, *, partition: list[str], group: str, order: list[Column], cap: int, top: int) -> DataFrame:
    """The first `top` rows of each partition in `order`, at most `cap` of each group; `position` 1..top.

    The first window limits every group before anything else is compared, so one large group costs
    `cap` rows.
    """
    in_group = F.row_number().over(Window.partitionBy(*partition, group).orderBy(*order))
    kept = df.withColumn("__g", in_group).where(F.col("__g") <= cap).drop("__g")
    position = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return kept.withColumn("position", position).where(F.col("position") <= top)


def first_per_group(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where("__r = 1").drop("__r")


def weighted_score(positive: dict[str, tuple[float, Column]], penalties: dict[str, tuple[float, Column]]) -> Column:
    """(sum of weight x score - sum of weight x penalty) / sum of positive weights; null for no weight."""
    total = sum(w for w, _ in positive.values())
    value = sum((F.lit(float(w)) * c for w, c in positive.values()), F.lit(0.0)) - sum((F.lit(float(w)) * c for w, c in penalties.values()), F.lit(0.0))
    return value / F.lit(float(total)) if total else F.lit(None).cast("double")


def interval_fit(lo: Column, hi: Column, want_lo: float, want_hi: float, tolerance: float) -> Column:
    """1 where [lo, hi] meets the wanted range, else fading to 0 at `tolerance`; 0.5 if both are null."""
    a, b = F.coalesce(lo, F.lit(0)), F.coalesce(hi, F.lit(100))
    gap = F.greatest(F.lit(want_lo) - b, a - F.lit(want_hi))
    return F.when(lo.isNull() & hi.isNull(), 0.5).when((F.least(b, F.lit(want_hi)) >= F.greatest(a, F.lit(want_lo))), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / tolerance) * 0.3)


def distance_fit(distance: Column, radius: float) -> Column:
    """1 within the radius, fading to 0 at twice the radius; 0.4 without a distance."""
    return F.when(distance.isNull(), 0.4).when(distance <= radius, 1.0).when(distance <= 2 * radius, 1 - (distance - radius) / radius).otherwise(0.0)


def saturation(title_hits: Column, body_hits: Column) -> Column:
    """Fades in: the fifth hit says less than the first; title hits count twice."""
    return 1 - F.exp(-(2.0 * title_hits + body_hits) / 3.0)


def half_life(moment: Column, now: Column, days: float) -> Column:
    """0.5 ** (age / days), never above 1; 0.5 for a missing moment."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))) / 86400)
    return F.coalesce(F.pow(F.lit(0.5), age / days), F.lit(0.5))
