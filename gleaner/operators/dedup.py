"""Entity resolution: exact groups, near-duplicates within a company, one vacancy on several portals.

The grouped, order-dependent operators scan a group front to back and compare each row with the heads
met so far. Groups are kept small by their keys, exact copies collapse before, and a group larger
than `max_group` is settled from its pairs instead, so no task holds an unbounded group; the result
is the same.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.text import content_hash, dedup_block, known_postal_code, normalize_company, normalize_title, shingles, url_key
from gleaner.operators.fuzzy import sorted_tokens, token_set, token_sort
from gleaner.operators.grouped import map_groups
from gleaner.session import at_most, cut


def portal_rank(portal: Column) -> Column:
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(V.PORTAL_ORDER))):
        rank = F.when(portal == name, i).otherwise(rank)
    return rank


def with_keys(jobs: DataFrame) -> DataFrame:
    """Adds title_key, company_key, content_hash, block and portal_rank."""
    return (
        jobs.withColumn("title_key", normalize_title(F.col("title"), F.col("city")))
        .withColumn("company_key", normalize_company(F.col("company_name")))
        .withColumn("content_hash", content_hash(F.col("title_key"), F.col("description_md")))
        .withColumn("postal_code", known_postal_code(F.col("postal_code")))  # stand-ins are no place
        .withColumn("block", dedup_block(F.col("postal_code"), F.col("city")))
        .withColumn("portal_rank", portal_rank(F.col("portal")))
    )


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that is last in `order`. Rows with a null key are dropped."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(last)
    return kept.select("r.*")


def exact_groups(jobs: DataFrame) -> DataFrame:
    """(id, group_id, group_size, is_group_representative) by equal company and title keys.

    The head has the lowest (portal rank, source id, id); the group's id is the head's content hash,
    16 digits. Aggregated before the shuffle and joined back: no group is collected.
    """
    keyed = with_keys(jobs)
    head = F.struct("portal_rank", "source_id", "id", "content_hash")
    groups = keyed.groupBy("company_key", "title_key").agg(F.count(F.lit(1)).alias("group_size"), F.min(head).alias("head"))
    joined = keyed.select("id", "company_key", "title_key").join(groups, ["company_key", "title_key"])
    return joined.select("id", F.substring("head.content_hash", 1, 16).alias("group_id"), "group_size", (F.col("id") == F.col("head.id")).alias("is_group_representative"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets of values (arrays without repeats); 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def near_merges(heads: DataFrame, threshold: float = V.NEAR_DUPLICATE) -> DataFrame:
    """heads(company_key, id, description_md) → (id, merged_into): near-duplicate heads of a company.

    Within a company, heads are taken in order of id; one whose shingles overlap those of an earlier
    kept head by `threshold` or more is merged into the first such head. Equal shingle sets collapse first,
    in the aggregation, and follow their smallest id. Candidates share a rare shingle (prefix filter
    over the company's own shingle counts), which loses no pair.
    """
    every = heads.select("company_key", "id", shingles(F.col("description_md")).alias("s")).where(F.size("s") > 0)
    every = every.withColumn("set", F.xxhash64(F.array_sort("s")))
    reps = every.groupBy("company_key", "set").agg(F.min("id").alias("rep"))
    placed = cut(every.join(reps, ["company_key", "set"]))
    grams = placed.where("id = rep").select("company_key", "id", "s")
    copies = placed.where("id <> rep").select("id", "rep")
    exploded = grams.select("company_key", "id", F.size("s").alias("n"), F.explode(F.transform("s", lambda x: F.xxhash64(x))).alias("h"))
    freq = exploded.groupBy("company_key", "h").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("company_key", "id").orderBy("df", "h")
    ranked = exploded.join(freq, ["company_key", "h"]).withColumn("k", F.row_number().over(order))
    # two sets with overlap >= t share one of the first n - ceil(t * n) + 1 elements in a common order
    prefix = ranked.where((F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1) & (F.col("df") > 1))
    a = prefix.select("company_key", "h", F.col("id").alias("a"), F.col("n").alias("na"))
    b = prefix.select("company_key", "h", F.col("id").alias("b"), F.col("n").alias("nb"))
    close = (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    candidates = a.join(b, ["company_key", "h"]).where("a < b").where(close).select("a", "b").distinct()
    sets = grams.select("id", "s")
    checked = (
        candidates.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .where(jaccard(F.col("sa"), F.col("sb")) >= threshold)
        .select("a", "b")
    )
    merged = first_match_merges(checked)
    followed = copies.join(merged.select(F.col("id").alias("rep"), "merged_into"), "rep", "left").select("id", F.coalesce("merged_into", "rep").alias("merged_into"))
    return merged.unionByName(followed)


def first_match_merges(pairs: DataFrame) -> DataFrame:
    """pairs(a < b) → (id, merged_into): each b goes to its smallest a that is itself kept.

    Every round settles all rows whose smaller partners are settled: rows without an open smaller
    partner are kept heads, and what they cover is merged into the smallest of them.
    """
    open_pairs = cut(pairs)
    merged = None
    while open_pairs.limit(1).count():
        has_smaller = open_pairs.select(F.col("b").alias("id")).distinct()
        kept = open_pairs.select(F.col("a").alias("id")).distinct().join(has_smaller, "id", "left_anti")
        # a row may be merged only if no open row smaller than its first kept partner could still be kept
        first = open_pairs.join(kept.withColumnRenamed("id", "a").withColumn("k", F.lit(True)), "a", "left")
        best = first.groupBy("b").agg(F.min(F.when(F.col("k"), F.col("a"))).alias("head"), F.min("a").alias("low"))
        now = cut(best.where(F.col("head").isNotNull()).select(F.col("b").alias("id"), F.col("head").alias("merged_into"), (F.col("head") == F.col("low")).alias("sure")))
        settled = now.where("sure").select("id", "merged_into")
        merged = settled if merged is None else merged.unionByName(settled)
        gone = settled.select("id")
        rest = open_pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        open_pairs = cut(rest)
    if merged is None:
        return pairs.select(F.col("b").alias("id"), F.col("a").alias("merged_into")).limit(0)
    return merged


def pair_scores(pairs: DataFrame) -> DataFrame:
    """pairs with title_a/b, company_a/b (keys), postal_a/b, city_a/b → adds title_similarity and score."""
    w = V.SIMILARITY_WEIGHTS
    place = (F.coalesce(F.nullif("postal_a", F.lit("")) == F.col("postal_b"), F.lit(False))) | F.coalesce(F.lower("city_a") == F.lower("city_b"), F.lit(False))
    scored = pairs.withColumn("title_similarity", token_sort("title_a", "title_b")).withColumn("company_similarity", token_set("company_a", "company_b"))
    return scored.withColumn("score", w["title"] * F.col("title_similarity") + w["company"] * F.col("company_similarity") + F.when(place, w["place"]).otherwise(0.0))


def cross_portal_clusters(jobs: DataFrame, max_group: int = 5_000) -> DataFrame:
    """(id, head_id): one vacancy seen on several portals.

    Rows with equal title and company keys at one place are the same job and collapse to one entry, in the
    aggregation. Within a block (postal code, else city) entries are taken by portal order and id;
    an entry joins the first bucket whose head passes the title gate and the weighted similarity, else it
    opens one. Rows sharing an application URL within a block follow the first of them, by a join. The
    block without a place can't reach the gate by names, so only copies and URLs count there. Blocks of
    more than `max_group` entries are not scanned in one task: their pairs are found by a join and the
    same order is settled in rounds (`_pairwise`), with the same heads.
    """
    keyed = with_keys(jobs).withColumn("apply_key", url_key(F.col("apply_url"))).withColumn("postal", F.coalesce("postal_code", F.lit(""))).withColumn("place", F.lower(F.coalesce("city", F.lit(""))))
    keys = ["block", "title_key", "company_key", "postal", "place"]
    order = F.struct("portal_rank", "id")
    entries = cut(keyed.groupBy(*keys).agg(F.min(order).alias("o")))
    placed = entries.where("block <> '?'")
    big = cut(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group).select("block"))
    shape = "block string, title_key string, company_key string, postal string, place string, head struct<portal_rank:int,id:bigint>"
    found = map_groups(placed.join(big, "block", "left_anti").select(*keys, "o"), ["block"], ["o"], _greedy, shape)
    if not at_most(big, 0):
        found = found.unionByName(_pairwise(placed.join(big, "block", "left_semi"), keys))
    heads = found.unionByName(entries.where("block = '?'").select(*keys, F.col("o").cast("struct<portal_rank:int,id:bigint>").alias("head")))
    rows = keyed.select("id", "portal_rank", "apply_key", *keys)
    with_head = rows.join(heads, [rows[k].eqNullSafe(heads[k]) for k in keys]).select(rows["id"], rows["block"], rows["apply_key"], rows["portal_rank"], "head")
    by_url = with_head.where(F.col("apply_key").isNotNull()).groupBy("block", "apply_key").agg(F.min_by("head", F.struct("portal_rank", "id")).alias("url_head"))
    return with_head.join(by_url, ["block", "apply_key"], "left").select("id", F.least("head", "url_head")["id"].alias("head_id"))


def similar_titles(titles: DataFrame, gate: float) -> DataFrame:
    """titles(block, t), distinct, words sorted → (block, ta, tb), both ways and each with itself: pairs of
    a block whose ratio reaches `gate`.

    With a common subsequence of L characters, two titles share 3L - la - lb - 1 pairs of neighbouring
    characters or more, which is at least (1.5 gate - 1)(la + lb) - 1; the shorter of the two has at
    least gate / (2 - gate) of the longer's length. So they share one of the rarest pairs of each (prefix
    filter), and none is lost. Titles below two characters have no pairs and only match themselves.
    """
    least = gate / (2.0 - gate)
    marked = titles.where(F.length("t") > 1)
    starts = F.sequence(F.lit(1), F.length("t") - 1)
    grams = marked.select("block", "t", F.explode(F.transform(starts, lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("g"))
    numbered = grams.groupBy("block", "t", "g").agg(F.count(F.lit(1)).cast("int").alias("c")).select("block", "t", "g", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("nth"))
    freq = numbered.groupBy("block", "g", "nth").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("block", "t").orderBy("df", "g", "nth")
    ranked = numbered.join(freq, ["block", "g", "nth"]).withColumn("k", F.row_number().over(order))
    # a little below the bound, for its rounding
    shared = F.ceil(F.lit((1.5 * gate - 1.0) * (1.0 + least)) * F.length("t") - 1.0 - 1e-6)
    prefix = cut(ranked.where((F.col("k") <= F.length("t") - F.greatest(shared, F.lit(1))) & (F.col("df") > 1)).select("block", "g", "nth", "t"))
    a, b = prefix.withColumnRenamed("t", "ta"), prefix.withColumnRenamed("t", "tb")
    la, lb = F.length("ta"), F.length("tb")
    near = (F.least(la, lb) >= F.lit(least - 1e-9) * F.greatest(la, lb))
    candidates = a.join(b, ["block", "g", "nth"]).where("ta < tb").where(near).select("block", "ta", "tb").distinct()
    pairs = cut(candidates.where(token_sort("ta", "tb") >= gate))
    swapped = pairs.select("block", F.col("tb").alias("ta"), F.col("ta").alias("tb"))
    return pairs.unionByName(swapped).unionByName(titles.select("block", F.col("t").alias("ta"), F.col("t").alias("tb")))


def _pairwise(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head) as `_greedy` gives it, for blocks of any size: candidates by title, exact scores in
    tasks of pairs, and the order of the entries settled in rounds."""
    # the hash tells entries apart that share an id
    e = F.struct(F.col("o.portal_rank").cast("int").alias("portal_rank"), F.col("o.id").cast("long").alias("id"), F.xxhash64(*keys).alias("h"))
    entries = cut(placed.select(*keys, e.alias("e"), sorted_tokens(F.coalesce("title_key", F.lit(""))).alias("t")))
    similar = similar_titles(entries.select("block", "t").distinct(), V.TITLE_GATE)

    def side(x: str) -> DataFrame:
        return entries.select("block", F.col("t").alias(f"t{x}"), F.col("e").alias(x), F.col("t").alias(f"title_{x}"), F.coalesce("company_key", F.lit("")).alias(f"company_{x}"), F.nullif("postal", F.lit("")).alias(f"postal_{x}"), F.nullif("place", F.lit("")).alias(f"city_{x}"))

    pairs = similar.join(side("a"), ["block", "ta"]).join(side("b"), ["block", "tb"]).where("a < b")
    close = pair_scores(pairs).where((F.col("title_similarity") >= V.TITLE_GATE) & (F.col("score") >= V.CROSS_PORTAL)).select("a", "b")
    merged = first_match_merges(close).withColumnRenamed("id", "e")
    head = F.coalesce("merged_into", "e")
    return entries.join(merged, "e", "left").select(*keys, F.struct(head["portal_rank"].alias("portal_rank"), head["id"].alias("id")).alias("head"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    from gleaner.operators.fuzzy import token_set_ratio, token_sort_ratio

    w = V.SIMILARITY_WEIGHTS
    heads: list[tuple] = []
    out = []
    for title, company, postal, place, o in zip(pdf["title_key"], pdf["company_key"], pdf["postal"], pdf["place"], pdf["o"]):
        hit = None
        for k, (t, c, p, q, _) in enumerate(heads):
            s = token_sort_ratio(title or "", t)
            if s < V.TITLE_GATE:
                continue
            near = w["place"] if (postal and postal == p) or (place and place == q) else 0.0
            if w["title"] * s + w["company"] * token_set_ratio(company or "", c) + near >= V.CROSS_PORTAL:
                hit = k
                break
        if hit is None:
            hit = len(heads)
            heads.append((title or "", company or "", postal, place, o))
        out.append(heads[hit][4])
    return pdf.assign(head=out)[["block", "title_key", "company_key", "postal", "place", "head"]]


def cluster_id(title_key: Column, company_key: Column, block: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", title_key, company_key, block), 256), 1, 16)


def merge_representatives(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row represents its group only if it is also the head of its cluster."""
    return groups.join(clusters.select("id", "head_id"), "id", "left").select(
        "id", "group_id", "group_size", (F.col("is_group_representative") & (F.coalesce("head_id", "id") == F.col("id"))).alias("is_group_representative")
    )


def dedup_stats(groups: DataFrame) -> DataFrame:
    """before, after, removed, biggest_group, reduction_pct over the heads of groups."""
    heads = groups.where("is_group_representative")
    return heads.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("before"), F.count(F.lit(1)).alias("after"), F.coalesce(F.max("group_size"), F.lit(0)).alias("biggest_group")).select(
        "before", "after", (F.col("before") - F.col("after")).alias("removed"), "biggest_group",
        F.when(F.col("before") > 0, F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 1)).otherwise(0.0).alias("reduction_pct"),
    )
