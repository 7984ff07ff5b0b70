"""One ranking from several scores on unlike scales.

Within each list (a profile) every score is standardised robustly, z = (x - median) / (1.4826 MAD),
squashed to (0, 1) by the logistic function, turned round where a high value counts against the
item, and the bounded values are combined by a weighted geometric mean. No score can dominate by
its range, and an outlier is worth at most 1.

* Where more than half of the values are equal, the MAD is 0 and the mean absolute deviation
  (x 1.2533) takes its place; where that is 0 too, the score says nothing and counts as 1/2.
* A score that is null, NaN or infinite, or missing from an item's map, counts as 1/2 (unknown); so does
  an item of a list without any finite score. Items without a list are left out.
* Medians and deviations are lower medians. By default they are quantile sketches, which merge from
  partial aggregates: exact in a list below ACCURACY items, with a rank error of at most n / ACCURACY in one
  of n items. With `exact` they are exact in any list, from range-partitioned counts of the distinct
  values; a list holding a third of all rows is spread over tasks either way.
* The whole ranking is range-partitioned as well; only the head (`top`) is cut by a window, which keeps
  `top` rows of a list in every task before the exchange.
* Ties in the ranking go to the smallest item id. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import ranked_within
from gleaner.session import at_most, cut, table

ACCURACY = 20_000
FLOOR = 1e-9


def _finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def lower_medians(long: DataFrame, value: str, exact: bool) -> DataFrame:
    """long(list_key, name, <value>) → (list_key, name, median): the lower median of each list and name."""
    keys = ["list_key", "name"]
    if not exact:
        return long.groupBy(*keys).agg(F.percentile_approx(value, 0.5, ACCURACY).alias("median"))
    counts = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    parts = cut(counts.repartitionByRange(*keys, value).withColumn("p", F.spark_partition_id()))
    sizes = parts.groupBy("p", *keys).agg(F.sum("c").alias("n"))  # one row per list, name and partition met
    of_list = Window.partitionBy(*keys)
    offsets = sizes.select("p", *keys, (F.sum("n").over(of_list.orderBy("p")) - F.col("n")).alias("before"), F.floor((F.sum("n").over(of_list) + 1) / 2).alias("wanted"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.join(offsets, ["p", *keys]).withColumn("upto", upto)
    return ranked.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("c") < F.col("wanted"))).select(*keys, F.col(value).alias("median"))


def robust_statistics(items: DataFrame, exact: bool = False) -> DataFrame:
    """items(list_key, scores map<string,double>) → (list_key, stats map<name, struct<median, scale>>).

    One row per list, holding one entry per score name.
    """
    long = items.select("list_key", F.explode("scores").alias("name", "x")).where(F.col("x").isNotNull())
    packed = cut(lower_medians(long, "x", exact).groupBy("list_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("medians")))
    off = F.abs(F.col("x") - F.col("medians")[F.col("name")])
    offs = _with_lists(long, packed).select("list_key", "name", off.alias("off"))
    by_name, mean_off = offs.groupBy("list_key", "name"), F.avg("off").alias("mean_off")
    if exact:
        spread = lower_medians(offs, "off", True).withColumnRenamed("median", "mad").join(by_name.agg(mean_off), ["list_key", "name"])
    else:
        spread = by_name.agg(F.percentile_approx("off", 0.5, ACCURACY).alias("mad"), mean_off)
    scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("mean_off") > 0, F.col("mean_off") * 1.2533)
    scales = spread.groupBy("list_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("name"), scale.alias("scale")))).alias("scales"))
    both = packed.join(scales, "list_key", "left")
    stats = F.transform_values("medians", lambda k, m: F.struct(m.alias("median"), F.col("scales")[k].alias("scale")))
    return cut(both.select("list_key", stats.alias("stats")))


def _with_lists(df: DataFrame, lists: DataFrame, how: str = "inner", max_broadcast_lists: int = 20_000) -> DataFrame:
    """Joins per-list values to items: by broadcast for provably few lists, else by an AQE-split join."""
    if at_most(lists.select("list_key"), max_broadcast_lists):
        return df.join(F.broadcast(lists), "list_key", how)
    return df.join(lists, "list_key", how)


def fused_ranking(items: DataFrame, *, against: str | None = None, weights: dict[str, float] | None = None, top: int | None = None, exact: bool = False) -> DataFrame:
    """items(list_key, item_id, scores map<string,double>) → (list_key, item_id, fused, position).

    Score names matching the regular expression `against` count against the item. `weights` gives
    weights other than 1 by name. `top` keeps the head of each list.
    """
    items = items.where(F.col("list_key").isNotNull()).select("list_key", "item_id", F.transform_values("scores", lambda k, v: _finite(v)).alias("scores"))
    items = cut(items)  # read by the medians, the deviations and the ranking
    stats = robust_statistics(items, exact)
    known = _with_lists(items, stats, "left")

    def part(k: Column, v: Column) -> Column:
        z = (F.col("scores")[k] - v["median"]) / v["scale"]
        z = F.when(k.rlike(against), -z).otherwise(z) if against else z
        bounded = F.coalesce(1.0 / (1.0 + F.exp(-z)), F.lit(0.5))
        w = F.lit(1.0)
        for name, value in (weights or {}).items():
            w = F.when(k == name, float(value)).otherwise(w)
        return F.struct(w.alias("w"), (w * F.ln(F.greatest(bounded, F.lit(FLOOR)))).alias("l"))

    parts = F.map_values(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("stats", part)))))  # one order of summing
    total = F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("l")),
        lambda s, p: F.struct((s["w"] + p["w"]).alias("w"), (s["l"] + p["l"]).alias("l")),
        lambda s: F.exp(s["l"] / s["w"]),
    )
    fused = known.select("list_key", "item_id", F.coalesce(total, F.lit(0.5)).alias("fused"))
    order = [F.col("fused").desc(), F.col("item_id")]
    if top is None:
        return ranked_within(fused, ["list_key"], order)
    ranked = fused.withColumn("position", F.row_number().over(Window.partitionBy("list_key").orderBy(*order)))
    return ranked.where(F.col("position") <= top)


def latest_scores(scores: DataFrame) -> DataFrame:
    """The latest run of each (profile, job) with all its scores in one map.

    Broken JSON gives no rules. Among rows of one moment the largest (final, semantic, rules) wins.
    """
    last = (
        scores.select("profile", "job_rowid", F.struct("computed_at", "final_score", "semantic_raw", "rules_json").alias("r"))
        .where(F.col("profile").isNotNull() & F.col("job_rowid").isNotNull())
        .groupBy("profile", "job_rowid")
        .agg(F.max("r").alias("r"))
    )
    rules = F.expr("try_variant_get(try_parse_json(r.rules_json), '$.scores', 'map<string,double>')")
    own = F.create_map(F.lit("final_score"), F.col("r.final_score"), F.lit("semantic_raw"), F.col("r.semantic_raw"))
    rules = F.map_filter(F.coalesce(rules, F.create_map().cast("map<string,double>")), lambda k, v: ~k.isin("final_score", "semantic_raw"))
    return last.select(F.col("profile").alias("list_key"), F.col("job_rowid").alias("item_id"), F.map_concat(own, rules).alias("scores"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scores", "profile", "job_rowid", "final_score", "semantic_raw", "rules_json", "computed_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten jobs at the head of each profile's combined ranking."""
    head = fused_ranking(latest_scores(_scores(spark, sf_dir)), against="_penalty$", top=10)
    return head.select(F.col("list_key").alias("profile"), F.col("item_id").alias("job_rowid"))


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole combined ranking of every profile."""
    ranked = fused_ranking(latest_scores(_scores(spark, sf_dir)), against="_penalty$")
    return ranked.select(F.col("list_key").alias("profile"), F.col("item_id").alias("job_rowid"), F.round("fused", 6).alias("fused"), "position")


_RANKED_SQL = """
WITH last AS (
  SELECT profile, job_rowid, final_score, semantic_raw, rules_json FROM scores
  WHERE profile IS NOT NULL AND job_rowid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY profile, job_rowid ORDER BY computed_at DESC NULLS LAST, final_score DESC NULLS LAST, semantic_raw DESC NULLS LAST, rules_json DESC NULLS LAST) = 1
), entries AS (
  SELECT profile, job_rowid, 'final_score' AS name, final_score AS x FROM last
  UNION ALL SELECT profile, job_rowid, 'semantic_raw', semantic_raw FROM last
  UNION ALL SELECT l.profile, l.job_rowid, e.key, TRY_CAST(e.value AS DOUBLE)
  FROM (SELECT * FROM last WHERE json_valid(rules_json)) l, json_each(l.rules_json, '$.scores') e
  WHERE e.key NOT IN ('final_score', 'semantic_raw')
), finite AS (SELECT * FROM entries WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
mid AS (SELECT profile, name, quantile_disc(x, 0.5) AS m FROM finite GROUP BY ALL),
dev AS (SELECT profile, name, m, quantile_disc(abs(x - m), 0.5) AS mad, avg(abs(x - m)) AS mean_off FROM finite JOIN mid USING (profile, name) GROUP BY ALL),
stat AS (SELECT profile, name, m, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN mean_off > 0 THEN mean_off * 1.2533 END AS s FROM dev),
part AS (
  SELECT l.profile, l.job_rowid, t.name,
         ln(greatest(coalesce(1.0 / (1.0 + exp(-(CASE WHEN ends_with(t.name, '_penalty') THEN -1 ELSE 1 END) * (f.x - t.m) / t.s)), 0.5), 1e-9)) AS l
  FROM last l LEFT JOIN stat t ON l.profile = t.profile
  LEFT JOIN finite f ON f.profile = l.profile AND f.job_rowid = l.job_rowid AND f.name = t.name
), fused AS (
  SELECT profile, job_rowid, coalesce(exp(list_sum(list(l ORDER BY name) FILTER (name IS NOT NULL)) / count(name)), 0.5) AS fused FROM part GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY profile ORDER BY fused DESC, job_rowid) AS position FROM fused
)
"""
P3_FOUND_SQL = _RANKED_SQL + "SELECT profile, job_rowid FROM ranked WHERE position <= 10"
P3_RANKING_SQL = _RANKED_SQL + "SELECT profile, job_rowid, round(fused, 6) AS fused, position FROM ranked"

QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
ORACLE_SQL = {"p3_found": P3_FOUND_SQL, "p3_ranking": P3_RANKING_SQL}
