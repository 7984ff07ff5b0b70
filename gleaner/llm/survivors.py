"""One surviving record per duplicate group, by skyline selection over its records.

A record is a point of (completeness, trust, recency): completeness counts its usable values, whole ones
above cut-off ones. The records of a group are peeled into dominance layers: the first layer holds those that no other
record matches or beats in all three and beats in one, the second those that only the first
layer beats, and so on. The lexicographic policy (trust, recency, smallest id) picks the base record
from the first layer. Its empty fields are filled from the layers in turn: each layer proposes, for
each field, its best usable value (whole before cut-off, then trust, recency, id), and a later layer's
proposal stands where no earlier one has any, or where the policy puts it first – a value of a less
complete record may be the more trusted one.

Before that a group of any size shrinks, with partial aggregation before the shuffle: of the
records that are usable in the same fields and equally trusted only the most recent one, then
the smallest id, can survive anywhere, so a group reaches the second step as at most (2 or 3 levels to
the number of fields) x (number of trust ranks) records.

Edge cases: null group keys are dropped; groups below `min_rows` give nothing; a field without any
usable value gives no row; null recency counts as the oldest, null or unknown trust as the last rank;
ties go to the smallest id; exact repeats of a row change nothing; empty tables give an empty result.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import texts

OLDEST = -(1 << 62)


@dataclass(frozen=True)
class SurvivingField:
    """A field, which of its values are usable, and which usable ones are whole (default: all)."""

    name: str
    usable: Column
    whole: Column | None = None

    def level(self) -> Column:
        """0 for an unusable value, 1 for a cut-off one, 2 for a whole one."""
        whole = F.lit(True) if self.whole is None else F.coalesce(self.whole, F.lit(False))
        return F.when(F.coalesce(self.usable, F.lit(False)), F.when(whole, 2).otherwise(1)).otherwise(0)


def _dominated(x: Column, rest: Column) -> Column:
    """Some record of `rest` is as complete, trusted and recent as `x`, and better in one of these."""
    return F.exists(
        rest,
        lambda y: (y["complete"] >= x["complete"])
        & (y["trust"] <= x["trust"])
        & (y["age"] <= x["age"])
        & ((y["complete"] > x["complete"]) | (y["trust"] < x["trust"]) | (y["age"] < x["age"])),
    )


def dominance_layers(records: Column, kind: str) -> Column:
    """Array of arrays: the Pareto layers of an array of records (struct type `kind`) with complete, trust, age."""

    def peel(state: Column, _: Column) -> Column:
        rest = state["rest"]
        front = F.filter(rest, lambda x: ~_dominated(x, rest))
        behind = F.filter(rest, lambda x: _dominated(x, rest))
        return F.when(F.size(rest) == 0, state).otherwise(F.struct(behind.alias("rest"), F.concat(state["layers"], F.array(front)).alias("layers")))

    start = F.struct(records.alias("rest"), F.array().cast(f"array<array<{kind}>>").alias("layers"))
    return F.aggregate(F.sequence(F.lit(1), F.size(records)), start, peel, lambda s: s["layers"])


def _fill(layers: Column, i: int) -> Column:
    """(order, layer, id) of the survivor of field `i`, proposed by the layers in turn; null without any."""
    proposal = "struct<poor:int,trust:int,age:bigint,id:bigint>"

    def best(layer: Column) -> Column:
        usable = F.filter(layer, lambda x: x["levels"][i] > 0)
        return F.array_min(F.transform(usable, lambda x: F.struct((-x["levels"][i]).alias("poor"), x["trust"].alias("trust"), x["age"].alias("age"), x["id"].alias("id")).cast(proposal)))

    def next_layer(state: Column, layer: Column) -> Column:
        own = best(layer)
        takes = own.isNotNull() & (state["best"].isNull() | (own < state["best"]))
        n = state["n"] + 1
        return F.struct(n.alias("n"), F.when(takes, own).otherwise(state["best"]).alias("best"), F.when(takes, n).otherwise(state["layer"]).alias("layer"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast(proposal).alias("best"), F.lit(0).alias("layer"))
    return F.aggregate(layers, start, next_layer, lambda s: F.when(s["best"].isNotNull(), F.struct(s["layer"].alias("layer"), s["best"]["id"].alias("id"))))


def surviving_rows(df: DataFrame, *, group: Column, fields: list[SurvivingField], trust: Column, recency: Column, row_id: Column, min_rows: int = 2) -> DataFrame:
    """(group_key, field_name, row_id, layer): for each group and field the row whose value survives, and the
    dominance layer of that row.

    `trust` is an integer rank (smallest is best) from a fixed policy list, `recency` a long.
    """
    base = df.select(
        group.alias("group_key"),
        F.coalesce(trust, F.lit(1 << 20)).cast("int").alias("trust"),
        (-F.coalesce(recency, F.lit(OLDEST))).alias("age"),
        row_id.cast("long").alias("id"),
        F.array(*(f.level().cast("int") for f in fields)).alias("levels"),
    ).where(F.col("group_key").isNotNull())
    alike = base.groupBy("group_key", "trust", "levels").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("age", "id")).alias("r"))
    complete = F.aggregate("levels", F.lit(0), lambda s, x: s + x)
    record = F.struct(complete.alias("complete"), F.col("trust"), F.col("r.age").alias("age"), F.col("r.id").alias("id"), F.col("levels"))
    grouped = alike.groupBy("group_key").agg(F.sum("n").alias("n"), F.collect_list(record).alias("records")).where(F.col("n") >= min_rows)
    kind = grouped.schema["records"].dataType.elementType.simpleString()
    layered = grouped.select("group_key", dominance_layers(F.col("records"), kind).alias("layers"))
    stacked = F.explode(F.array(*(F.struct(F.lit(f.name).alias("field_name"), _fill(F.col("layers"), i).alias("s")) for i, f in enumerate(fields))))
    picks = layered.select("group_key", stacked.alias("p")).where(F.col("p.s").isNotNull())
    return picks.select("group_key", "p.field_name", F.col("p.s.id").alias("row_id"), F.col("p.s.layer").alias("layer"))


def built_records(df: DataFrame, picks: DataFrame, *, row_id: str, values: dict[str, str]) -> DataFrame:
    """One row per group: every field's surviving value, the id of the row it comes from, and that row's layer.

    `values` maps field names (as in `picks`) to columns of `df`.
    """
    source = df.select(F.col(row_id).cast("long").alias("row_id"), *(F.col(c).alias(f"v_{i}") for i, c in enumerate(values.values())))
    joined = picks.join(source, "row_id")
    of = lambda name, c: F.min(F.when(F.col("field_name") == name, F.col(c)))
    return joined.groupBy("group_key").agg(
        *(of(name, f"v_{i}").alias(name) for i, name in enumerate(values)),
        *(of(name, "row_id").alias(f"{name}_from") for name in values),
        *(of(name, "layer").alias(f"{name}_layer") for name in values),
    )


# Portals in the order of trust, and values that merely stand in for a missing one.
PORTALS = ["job_room", "myjob", "ostjob", "zentraljob"]
STAND_INS = ["-", "--", "#", "?", "0", "n/a", "na", "n.a.", "k.a.", "k. a.", "keine angabe", "none", "null", "nil", "unknown", "unbekannt", "tbd", "x", "xx", "0000", "00000", "http://", "https://", "about:blank"]
CUT_OFF = r"(?iU)(\.\.\.|…)\s*\]?\)?(\s*\[?(mehr|weiterlesen|more|read more|suite|lire la suite|altro|continua|leggi tutto)\]?)?(\s|&nbsp;|<[^<>]*>|\*|_)*$"


def portal_rank(portal: Column) -> Column:
    """Rank of a portal whatever its spelling (case, spaces, dashes, underscores); null if unknown."""
    plain = F.regexp_replace(F.lower(portal), r"[^a-z]", "")
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(PORTALS))):
        rank = F.when(plain == name.replace("_", ""), i).otherwise(rank)
    return rank


def usable_text(value: Column) -> Column:
    """Neither null, nor blank, nor a stand-in."""
    plain = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return value.isNotNull() & (plain != "") & ~plain.isin(STAND_INS)


def job_fields() -> list[SurvivingField]:
    text = F.col("description_md")
    moment = F.col("expires_at").cast("timestamp_ntz")
    return [
        SurvivingField("description_md", usable_text(text), ~text.rlike(CUT_OFF)),
        SurvivingField("postal_code", usable_text(F.col("postal_code"))),
        SurvivingField("workload_max", F.col("workload_max").isNotNull()),
        SurvivingField("expires_at", moment.isNotNull() & (F.year(moment) < 9999) & (F.year(moment) > 1900)),
        SurvivingField("apply_url", usable_text(F.col("apply_url"))),
    ]


JOB_COLUMNS = ("id", "cluster_id", "portal", "last_seen_at", "description_md", "postal_code", "workload_max", "expires_at", "apply_url")


def _job_picks(jobs: DataFrame) -> DataFrame:
    seen = F.unix_micros(F.col("last_seen_at").cast("timestamp"))
    return surviving_rows(jobs, group=F.col("cluster_id"), fields=job_fields(), trust=portal_rank(F.col("portal")), recency=seen, row_id=F.col("id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cluster of two or more rows and each field the row whose value survives."""
    picks = _job_picks(texts(spark, sf_dir, "jobs", *JOB_COLUMNS))
    return picks.select(F.col("group_key").alias("cluster_id"), "field_name", F.col("row_id").alias("job_id"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each cluster, built from the surviving fields, with their origins."""
    jobs = texts(spark, sf_dir, "jobs", *JOB_COLUMNS)
    names = [f.name for f in job_fields()]
    built = built_records(jobs, _job_picks(jobs), row_id="id", values={n: n for n in names})
    return built.select(F.col("group_key").alias("cluster_id"), *names, *(f"{n}_from" for n in names))


_STAND_INS_SQL = ", ".join("'" + s + "'" for s in STAND_INS)
_USABLE_SQL = "{c} IS NOT NULL AND trim({c}, ' \t\n\r') <> '' AND lower(trim({c}, ' \t\n\r')) NOT IN (" + _STAND_INS_SQL + ")"

_PICKS_SQL = f"""
WITH j AS (
  SELECT *, CASE regexp_replace(lower(portal), '[^a-z]', '', 'g')
              WHEN 'jobroom' THEN 0 WHEN 'myjob' THEN 1 WHEN 'ostjob' THEN 2 WHEN 'zentraljob' THEN 3 ELSE 9 END AS trust,
         count(*) OVER (PARTITION BY cluster_id) AS n
  FROM jobs WHERE cluster_id IS NOT NULL
), f AS (
  SELECT cluster_id, 'description_md' AS field_name, id, trust, last_seen_at, n,
         CASE WHEN regexp_matches(description_md, '(?i)(\\.\\.\\.|…)\\s*\\]?\\)?(\\s*\\[?(mehr|weiterlesen|more|read more|suite|lire la suite|altro|continua|leggi tutto)\\]?)?(\\s|&nbsp;|<[^<>]*>|\\*|_)*$')
              THEN 1 ELSE 0 END AS cut
  FROM j WHERE {_USABLE_SQL.format(c='description_md')}
  UNION ALL SELECT cluster_id, 'postal_code', id, trust, last_seen_at, n, 0 FROM j WHERE {_USABLE_SQL.format(c='postal_code')}
  UNION ALL SELECT cluster_id, 'workload_max', id, trust, last_seen_at, n, 0 FROM j WHERE workload_max IS NOT NULL
  UNION ALL SELECT cluster_id, 'expires_at', id, trust, last_seen_at, n, 0 FROM j WHERE year(expires_at) BETWEEN 1901 AND 9998
  UNION ALL SELECT cluster_id, 'apply_url', id, trust, last_seen_at, n, 0 FROM j WHERE {_USABLE_SQL.format(c='apply_url')}
)
, picks AS (
  SELECT cluster_id, field_name, id AS job_id FROM f WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY cut, trust, last_seen_at DESC NULLS LAST, id) = 1
)
"""
P2_FOUND_SQL = _PICKS_SQL + "SELECT cluster_id, field_name, job_id FROM picks"

_BUILT = ["description_md", "postal_code", "workload_max", "expires_at", "apply_url"]
P2_RECORDS_SQL = (
    _PICKS_SQL
    + "SELECT p.cluster_id, "
    + ", ".join(f"max(CASE WHEN field_name = '{c}' THEN r.{c} END) AS {c}, max(CASE WHEN field_name = '{c}' THEN job_id END) AS {c}_from" for c in _BUILT)
    + " FROM picks p JOIN jobs r ON r.id = p.job_id GROUP BY p.cluster_id"
)

QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
ORACLE_SQL = {"p2_found": P2_FOUND_SQL, "p2_records": P2_RECORDS_SQL}
