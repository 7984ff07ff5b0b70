"""Characteristic terms, skills, and clusters of vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.text import strip_html
from gleaner.functions.vectors import embed_udf


def words_of(text: Column) -> Column:
    """Distinct words of four or more letters that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(strip_html(text)), F.lit("[a-zäöüß]{4,}"), 0))
    return F.filter(found, lambda w: ~w.isin(sorted(set(V.TERM_STOP_WORDS))))


def characteristic_terms(docs: DataFrame, *, group: str, text: str, top: int = 6) -> DataFrame:
    """(group, term, df, score, position): words more frequent in a group's rows than in all rows.

    Document frequencies in the group (at least 3, and a tenth of its rows) times the log of the ratio of
    the shares; only positive scores. Rows without a group count among all rows only.
    """
    rows = docs.select(F.col(group).alias("g"), words_of(F.col(text)).alias("w"))
    total = rows.count()
    sizes = rows.where(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    by_group = rows.select("g", F.explode("w").alias("term")).groupBy("g", "term").agg(F.count(F.lit(1)).alias("df"))
    overall = by_group.groupBy("term").agg(F.sum("df").alias("df_all"))
    kept = by_group.where(F.col("g").isNotNull()).join(sizes, "g").where(F.col("df") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.10)))
    shares = kept.join(overall, "term")
    inside, everywhere = F.col("df") / F.col("n"), F.col("df_all") / F.lit(max(1, total))
    scored = shares.withColumn("score", inside * F.ln(inside / everywhere + 1e-9)).where(F.col("score") > 0)
    position = F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("position", position).where(F.col("position") <= top).select(F.col("g").alias(group), "term", "df", "score", "position")


def skill_pattern(names: list[str]) -> str:
    """Matches any of the names as a whole, longest first, not within words or dotted names."""
    alternatives = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return rf"(?iU)(?<!\w)(?<!\w\.)(?:{alternatives})(?!\w)(?!\.\w)"


def skills_found(text: Column, skills: dict[str, list[str]]) -> Column:
    """Names of the skills whose name or alias occurs."""
    plain = strip_html(text)
    return F.array_compact(F.array(*(F.when(plain.rlike(skill_pattern([name, *aliases])), F.lit(name)) for name, aliases in skills.items())))


def skill_demand(docs: DataFrame, *, group: str, text: str, skills: dict[str, list[str]], own: list[str], share: float = V.SKILL_SHARE) -> DataFrame:
    """(group, skill, demand, share, own, gap): how many rows of a group ask for a skill."""
    rows = docs.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), skills_found(F.col(text), skills).alias("s"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    demand = rows.select("g", F.explode("s").alias("skill")).groupBy("g", "skill").agg(F.count(F.lit(1)).alias("demand"))
    part = F.round(F.col("demand") / F.col("n"), 3)
    has = F.col("skill").isin(own) if own else F.lit(False)
    return demand.join(sizes, "g").select(F.col("g").alias(group), "skill", "demand", part.alias("share"), has.alias("own"), (~has & (part >= share)).alias("gap"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, *, block: int = 2048) -> DataFrame:
    """queries(p_id, v), rows(r_id, r_v, …) → the k rows with the largest dot product per query, exactly.

    `queries` is a stated set; it goes to the workers in blocks of at most `block` vectors, and a block is held
    against every row in one pass over `rows`, where they lie. A task keeps k rows per query, so what
    is shuffled is at most k x queries x tasks, whatever the number of rows. Null vectors have no neighbours.
    """
    spark = rows.sparkSession
    p_type, r_type = queries.schema["p_id"].dataType.simpleString(), rows.schema["r_id"].dataType.simpleString()
    asked = queries.where(F.col("p_id").isNotNull() & F.col("v").isNotNull()).select("p_id", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    held = rows.where(F.col("r_v").isNotNull()).select("r_id", F.col("r_v").cast("array<double>").alias("r_v"))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("p_id"), F.lit(blocks)) == b)
        own = part.collect()  # about `block` vectors
        if not own:
            continue
        shared = spark.sparkContext.broadcast(([r["p_id"] for r in own], np.array([r["v"] for r in own])))

        def top(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            best_s, best_r = np.empty((len(ids), 0)), np.empty((len(ids), 0), object)
            for pdf in batches:
                if not len(pdf):
                    continue
                sims = np.concatenate((best_s, vectors @ np.stack(pdf["r_v"].to_numpy()).T), axis=1)
                names = np.concatenate((best_r, np.broadcast_to(pdf["r_id"].to_numpy().astype(object), (len(ids), len(pdf)))), axis=1)
                if sims.shape[1] > k:
                    # the k-th largest and whatever ties with it, then the smallest ids
                    least = np.partition(sims, -k, axis=1)[:, -k]
                    order = [sorted(np.flatnonzero(s >= m).tolist(), key=lambda i, s=s, n=n: (-s[i], n[i]))[:k] for s, m, n in zip(sims, least, names)]
                    best_s = np.array([s[o] for s, o in zip(sims, order)])
                    best_r = np.array([n[o] for n, o in zip(names, order)], dtype=object)
                else:
                    best_s, best_r = sims, names
            width = best_s.shape[1]
            yield pd.DataFrame({"p_id": np.repeat(np.array(ids, object), width), "r_id": best_r.ravel(), "similarity": best_s.ravel()})

        near = held.mapInPandas(top, f"p_id {p_type}, r_id {r_type}, similarity double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], f"p_id {p_type}, r_id {r_type}, similarity double")
    position = F.row_number().over(Window.partitionBy("p_id").orderBy(F.col("similarity").desc(), "r_id"))
    kept = found.withColumn("position", position).where(F.col("position") <= k)
    return kept.join(rows.drop("r_v"), "r_id")


def majority_vote(neighbours: DataFrame, label: str, share: float = V.VOTE_SHARE) -> DataFrame:
    """(p_id, label, agreement, best): the most frequent label among the neighbours, if frequent enough.

    `best` is the nearest neighbour with that label; ties between labels go to the nearer one.
    """
    n = neighbours.groupBy("p_id").agg(F.count(F.lit(1)).alias("n"))
    votes = neighbours.groupBy("p_id", label).agg(F.count(F.lit(1)).alias("c"), F.min("position").alias("first"), F.min_by("r_id", "position").alias("best"))
    order = F.row_number().over(Window.partitionBy("p_id").orderBy(F.col("c").desc(), "first"))
    top = votes.withColumn("k", order).where("k = 1").join(n, "p_id")
    return top.where(F.col("c") / F.col("n") >= share).select("p_id", label, F.round(F.col("c") / F.col("n"), 2).alias("agreement"), "best")


def label_clusters(titles: DataFrame, taxonomy: DataFrame, embedder, *, votes: int = V.VOTE_NEIGHBOURS, share: float = V.VOTE_SHARE, per_cluster: int = 12) -> DataFrame:
    """titles(cluster, title), taxonomy(title, field) → (cluster, field, agreement, best): the field that the
    occupations nearest to a cluster's most frequent titles agree on; clusters without agreement have no row.

    Titles are compared with titles: the text of a cluster is its `per_cluster` most frequent ones.
    """
    named = titles.where(F.col("cluster").isNotNull() & F.col("title").isNotNull())
    counts = named.groupBy("cluster", "title").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "title"))
    heads = counts.withColumn("k", rank).where(F.col("k") <= per_cluster).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("t"))
    vector = embed_udf(embedder)
    asked = heads.select(F.col("cluster").alias("p_id"), vector(F.array_join(F.transform("t", lambda x: x["title"]), "; ")).alias("v"))
    known = taxonomy.where(F.col("title").isNotNull()).select(F.col("title").alias("r_id"), "field").dropDuplicates(["r_id"])
    near = nearest(asked, known.select("r_id", "field", vector("r_id").alias("r_v")), votes)
    size = near.groupBy("p_id").agg(F.count(F.lit(1)).alias("n"))  # those without a field count in the share, not in the vote
    cast = near.where(F.col("field").isNotNull()).groupBy("p_id", "field").agg(F.count(F.lit(1)).alias("c"), F.min("position").alias("first"), F.min_by("r_id", "position").alias("best"))
    order = F.row_number().over(Window.partitionBy("p_id").orderBy(F.col("c").desc(), "first"))
    won = cast.withColumn("k", order).where("k = 1").join(size, "p_id").where(F.col("c") / F.col("n") >= share)
    return won.select(F.col("p_id").alias("cluster"), "field", F.round(F.col("c") / F.col("n"), 2).alias("agreement"), "best")


def cluster_name(cluster: Column, field: Column, words: Column) -> Column:
    """'field — a, b, c', or what there is of it, else 'Cluster n'."""
    three = F.nullif(F.array_join(F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, 3), ", "), F.lit(""))
    return F.when(field.isNotNull(), F.concat_ws(" — ", field, three)).otherwise(F.coalesce(three, F.concat(F.lit("Cluster "), cluster.cast("string"))))


def cluster_report(labelled: DataFrame) -> DataFrame:
    """(clusters, noise, total, noise_share) of labels as `vector_clusters` gives them, -1 being noise."""
    noise, total = F.count_if(F.col("label") == -1), F.count(F.lit(1))
    return labelled.agg(
        F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("clusters"), noise.alias("noise"), total.alias("total"),
        F.when(total > 0, F.round(100.0 * noise / total, 1)).otherwise(0.0).alias("noise_share"),
    )


def vector_clusters(df: DataFrame, *, key: str, vector: str, min_size: int = 25, k: int | None = None, dims: int = 12, seed: int = 42) -> DataFrame:
    """(key, label): PCA, bisecting k-means, and label -1 for clusters below `min_size`.

    A stand-in for density clustering, which Spark lacks: distributed, seeded, and with the same rule
    that small clusters are noise. Fewer than 2 x min_size rows give no labels. Without `k`, the number of
    clusters grows with the rows, one for every 4 x min_size of them: it follows their number, not
    their density, so dense groups may be split and groups below that size may share a cluster.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key), array_to_vector(F.col(vector).cast("array<double>")).alias("f"))
    n = rows.count()
    if n < 2 * min_size:
        return rows.select(key, F.lit(-1).alias("label")).limit(0)
    size = rows.first()["f"].size
    reduced = PCA(k=min(dims, size), inputCol="f", outputCol="r").fit(rows).transform(rows)
    k = k or max(2, n // (4 * min_size))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="r", predictionCol="label", minDivisibleClusterSize=float(2 * min_size)).fit(reduced)
    labelled = model.transform(reduced).select(key, "label")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    few = F.broadcast(sizes) if k <= 100_000 else sizes  # one row per cluster, at most k
    return labelled.join(few, "label").select(key, F.when(F.col("n") < min_size, -1).otherwise(F.col("label")).alias("label"))
