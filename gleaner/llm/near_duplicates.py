"""Near-duplicate records: a Hamming self-join over a binary trie, then an exact check.

Every record gets a block (equal company and title keys), the set of its word shingles, and a
signature of 256 one-bit minhashes. Two signatures differ in each bit with probability (1 - J) / 2,
J being the Jaccard similarity of the shingle sets, so pairs of similarity `threshold` or more stay
within an error budget that is known for every depth d of the trie: the expected number of differing
bits plus `SIGMAS` standard deviations. Per pair the chance to be lost is below one in a million.

* Copies (equal block and shingle set) collapse to one representative. Blocks of at most `split_rows` rows
  are shuffled once, by block, and collapse in their task; in larger (hot) blocks copies are aggregated
  before the shuffle, so that a group of copies of any size is one signature.
* The representatives of a hot block are ranked by signature (range partitions, no task holds the block)
  and cut into parts of `split_rows`: each part is an interval of trie nodes. Two parts whose common
  prefixes differ beyond the budget are pruned as a pair of nodes; every other pair of parts is a
  group of its own: no group exceeds 2 x split_rows, and no partner is dropped.
* Within a task the trie is traversed level by level by pairs of nodes, those of all groups at once:
  differing bits accumulate from the root, a pair of nodes is pruned as soon as the budget of its depth
  is exceeded, and a path that has come down to one signature on either side is compared to its end.
  Survivors are compared exactly, by the 64-bit hashes of all their shingles.

`near_duplicates` gives links between representatives and the membership of all records; `pairs` expands
copies and is for those who need every pair.

Edge cases: null or blank company or title keys and texts below `min_words` words have no partners;
repeated ids are one record; ties don't matter; an empty table gives empty results; further columns
are ignored. Very long texts are processed whole. Null ids are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.components import connected_components
from gleaner.llm.markup import plain_words
from gleaner.operators.ranking import ranked_within
from gleaner.session import at_most, cut, texts

BITS = 256
SIGMAS = 5.5
WIDE = 1 << 18
_LETTERS = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240607)
_MULTIPLIERS = (_RNG.integers(1, 1 << 63, BITS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64)
_P1, _P2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` word hashes; fewer words make one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    h = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        h = (h * _P1) ^ (words[k : len(words) - size + 1 + k] * _P2 + (h >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-bit minhashes of each (non-empty) set, packed into BITS / 64 words."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i in range(BITS):
        low = np.minimum.reduceat(flat * _MULTIPLIERS[i] + _OFFSETS[i], starts)
        out[:, i // 64] |= ((low >> np.uint64(11)) & np.uint64(1)) << np.uint64(63 - i % 64)
    return out


def budget(depth: int, threshold: float) -> int:
    """Differing bits allowed among the first `depth` bits of a pair at the threshold."""
    p = (1.0 - threshold) / 2.0
    return min(depth, math.floor(p * depth + SIGMAS * math.sqrt(p * (1 - p) * depth)))


def trie_pairs(words: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows within the error budget, for every (l0, l1, r0, r1) of `nodes`: rows [l0, l1) with
    rows [r0, r1), both sorted by signature; equal ranges are joined with themselves (i < j).

    All pairs of nodes go down the trie together; a frontier of more than `WIDE` is cut and its halves go on
    one after the other.
    """
    budgets = np.array([budget(d, threshold) for d in range(BITS + 1)])
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            if len(ones) * len(words) > 4_000_000:
                ones.clear()
            bits = (words[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bits.astype(np.int32))))
        return ones[depth]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, np.asarray(nodes, np.int64).reshape(-1, 4), np.zeros(len(nodes), np.int64))]
    while stack:
        depth, n, errors = stack.pop()
        l0, l1, r0, r1 = n.T
        own = (l0 == r0) & (l1 == r1)
        leaf = ((l1 - l0) * (r1 - r0) == 1) & ~own
        if leaf.any():
            found.append((l0[leaf], r0[leaf]))
        on = ~leaf & ~(own & (l1 - l0 < 2))
        n, errors, own = n[on], errors[on], own[on]
        if not len(n):
            continue
        if len(n) > WIDE:
            half = len(n) // 2
            stack += [(depth, n[:half], errors[:half]), (depth, n[half:], errors[half:])]
            continue
        if depth == BITS:  # equal signatures on either side
            for (a, b, c, d), mine in zip(n.tolist(), own.tolist()):
                i, j = (x + a for x in np.triu_indices(b - a, 1)) if mine else (x.ravel() for x in np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij"))
                found.append((i, j))
            continue
        before = ones_before(depth)
        l0, l1, r0, r1 = n.T
        lm, rm = l1 - (before[l1] - before[l0]), r1 - (before[r1] - before[r0])
        # within one node the mirrored pair of children is the same pair
        other = ~own
        children = np.concatenate((np.stack((l0, lm, r0, rm), 1), np.stack((lm, l1, rm, r1), 1), np.stack((l0, lm, rm, r1), 1), np.stack((lm, l1, r0, rm), 1)[other]))
        differing = np.concatenate((errors, errors, errors + 1, errors[other] + 1))
        alive = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (differing <= budgets[depth + 1])
        stack.append((depth + 1, children[alive], differing[alive]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    # the rest of the paths of single signatures
    errors = np.zeros(len(i), np.int64)
    for w in range(BITS // 64):
        errors += np.bitwise_count(words[i, w] ^ words[j, w])
        keep = errors <= budgets[64 * (w + 1)]
        i, j, errors = i[keep], j[keep], errors[keep]
    return i, j


def trie_join(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures within the error budget; `right` None joins `left` with itself."""
    orders = [np.lexsort(x.T[::-1]) for x in ((left,) if right is None else (left, right))]
    words = np.concatenate([x[o] for x, o in zip((left, right), orders)])
    n = len(left)
    i, j = trie_pairs(words, np.array([(0, n, 0, n) if right is None else (0, n, n, len(words))]), threshold)
    return orders[0][i], orders[-1][j if right is None else j - n]


def parts_may_meet(low_a: bytes, high_a: bytes, low_b: bytes, high_b: bytes, threshold: float) -> bool:
    """Whether two intervals of signatures can hold a pair within the budget, by the prefix each has in common."""
    at = [int.from_bytes(x, "big") for x in (low_a, high_a, low_b, high_b)]
    common = BITS - max((at[0] ^ at[1]).bit_length(), (at[2] ^ at[3]).bit_length())
    differing = (at[0] ^ at[2]) >> (BITS - common)
    return all((differing >> (common - d)).bit_count() <= budget(d, threshold) for d in range(1, common + 1))


_FEATURES = "id long, block long, class long, n int, signature binary, shingles binary"


def features(df: DataFrame, *, shingle: int, min_words: int) -> DataFrame:
    """df(id, block, text) → one row per record with enough words: class, signature and shingles."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                yield _features_of(pdf.iloc[at : at + 2000], known, shingle, min_words)
            if len(known) > 500_000:
                known.clear()

    return df.mapInPandas(make, _FEATURES)


def _features_of(pdf: pd.DataFrame, known: dict[str, int], shingle: int, min_words: int) -> pd.DataFrame:
    ids, blocks, sets = [], [], []
    for i, block, text in zip(pdf["id"], pdf["block"], pdf["text"]):
        words = _LETTERS.findall(plain_words(text).lower())
        if len(words) < min_words:
            continue
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(i)
        blocks.append(block)
        sets.append(shingle_hashes(np.fromiter((known[w] for w in words), np.uint64, len(words)), shingle))
    if not ids:
        return pd.DataFrame({c: [] for c in ("id", "block", "class", "n", "signature", "shingles")})
    packed = signatures(sets)
    return pd.DataFrame(
        {
            "id": ids,
            "block": blocks,
            "class": [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets],
            "n": [len(s) for s in sets],
            "signature": [row.tobytes() for row in packed.byteswap()],  # the first bytes hold the first bits
            "shingles": [s.tobytes() for s in sets],
        }
    )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def _join_groups(threshold: float):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group may reach into the next batch."""
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[["block", "pa", "pb"]].to_numpy()
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            last = int(changes[-1]) + 1 if len(changes) else 0
            rest = pdf.iloc[last:]
            if last:
                yield _pairs_of(pdf.iloc[:last], keys[:last], threshold)
        if rest is not None and len(rest):
            yield _pairs_of(rest, rest[["block", "pa", "pb"]].to_numpy(), threshold)

    return join


def _pairs_of(pdf: pd.DataFrame, keys: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links within each run of equal keys; copies within a run collapse to the smallest id first."""
    group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
    ids, part, kind, counts = (pdf[c].to_numpy() for c in ("id", "part", "class", "n"))
    order = np.lexsort((ids, kind, group))
    first = order[np.r_[True, (group[order][1:] != group[order][:-1]) | (kind[order][1:] != kind[order][:-1])]]
    size = np.bincount(group[first], minlength=group[-1] + 1)
    first = first[size[group[first]] > 1]  # nothing to compare with
    if not len(first):
        return pd.DataFrame({"rep_a": [], "rep_b": [], "similarity": []})
    signatures_ = pdf["signature"].to_numpy()[first]
    words = np.frombuffer(b"".join(signatures_), ">u8").astype(np.uint64).reshape(len(first), -1)
    order = np.lexsort((*words.T[::-1], part[first], group[first]))
    first, words = first[order], words[order]
    g, p = group[first], part[first]
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    nodes = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mid = lo + int(np.searchsorted(p[lo:hi], p[lo], side="right"))
        if mid < hi:
            nodes.append((lo, mid, mid, hi))
        elif keys[first[lo], 1] == keys[first[lo], 2]:
            nodes.append((lo, hi, lo, hi))
    i, j = trie_pairs(words, np.array(nodes, np.int64).reshape(-1, 4), threshold)
    i, j = first[i], first[j]
    small, large = np.minimum(counts[i], counts[j]), np.maximum(counts[i], counts[j])
    near = small >= threshold * large
    shingles = pdf["shingles"].to_numpy()
    cache: dict[int, np.ndarray] = {}

    def at(k: int) -> np.ndarray:
        if k not in cache:
            cache[k] = np.frombuffer(shingles[k], np.uint64)
        return cache[k]

    out = []
    for x, y in zip(i[near].tolist(), j[near].tolist()):
        s = _jaccard(at(x), at(y))
        if s >= threshold:
            out.append((min(ids[x], ids[y]), max(ids[x], ids[y]), s))
    return pd.DataFrame(out, columns=["rep_a", "rep_b", "similarity"])


_GROUP = ["block", "pa", "pb"]
_SHIPPED = [*_GROUP, "part", "class", "id", "n", "signature", "shingles"]


def hot_parts(classes: DataFrame, split_rows: int) -> DataFrame:
    """classes(block, id, signature, …) → with `part`: intervals of `split_rows` signatures of each block."""
    ranked = ranked_within(classes, ["block"], [F.col("signature"), F.col("id")])
    return ranked.withColumn("part", F.floor((F.col("position") - 1) / F.lit(split_rows)).cast("int")).drop("position")


def part_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """(block, pa, pb): the pairs of parts, and each part with itself, that the trie does not prune.

    There is one part for `split_rows` representatives of a hot block.
    """
    ends = cut(placed.groupBy("block", "part").agg(F.min("signature").alias("low"), F.max("signature").alias("high")))
    a = ends.select("block", F.col("part").alias("pa"), F.col("low").alias("la"), F.col("high").alias("ha"))
    b = ends.select("block", F.col("part").alias("pb"), F.col("low").alias("lb"), F.col("high").alias("hb"))

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [x == y or parts_may_meet(la, ha, lb, hb, threshold) for x, y, la, ha, lb, hb in zip(pdf["pa"], pdf["pb"], pdf["la"], pdf["ha"], pdf["lb"], pdf["hb"])]
            yield pdf.loc[kept, ["block", "pa", "pb"]]

    return a.join(b, "block").where("pa <= pb").mapInPandas(prune, "block long, pa int, pb int")


def near_duplicates(df: DataFrame, *, threshold: float = 0.8, shingle: int = 5, min_words: int = 1, split_rows: int = 4096, max_hot_blocks: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """df(id, block long, text) → (links, members).

    links(rep_a, rep_b, similarity): every pair of class representatives at or above `threshold`
    in one block. members(id, block, rep, copies): the class of every record that has features.
    """
    usable = df.where(F.col("id").isNotNull() & F.col("block").isNotNull() & (F.length("text") > 0))
    rows = cut(features(usable.select("id", "block", "text"), shingle=shingle, min_words=min_words))
    hot = cut(rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > split_rows).select("block"))
    schema = "rep_a long, rep_b long, similarity double"
    whole = lambda d: d.select("block", F.lit(0).alias("pa"), F.lit(0).alias("pb"), F.lit(0).alias("part"), *_SHIPPED[4:])
    if at_most(hot, 0):
        cool = whole(rows)
        links = None
    else:
        marked = F.broadcast(hot) if at_most(hot, max_hot_blocks) else hot
        cool = whole(rows.join(marked, "block", "left_anti"))
        classes = rows.join(marked, "block", "left_semi").groupBy("block", "class").agg(
            F.min("id").alias("id"), F.min("n").alias("n"), F.min("signature").alias("signature"), F.min("shingles").alias("shingles")
        )
        placed = cut(hot_parts(classes, split_rows))
        meeting = cut(part_pairs(placed, threshold))
        mates = meeting.select("block", F.explode(F.array_distinct(F.array("pa", "pb"))).alias("part"), "pa", "pb")
        spread = placed.join(mates, ["block", "part"]).select(*_SHIPPED).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        links = spread.mapInPandas(_join_groups(threshold), schema)
    cool_links = cool.repartition("block").sortWithinPartitions("block").mapInPandas(_join_groups(threshold), schema)
    links = cool_links if links is None else cool_links.unionByName(links)
    reps = rows.groupBy("block", "class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = rows.select("id", "block", "class").join(reps, ["block", "class"]).select("id", "block", "rep", "copies")
    return links, members


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of records: across linked classes and within classes of copies."""
    m = members.select("id", "rep", "copies").distinct()
    # almost every class has one member: only those with copies are expanded by a join
    several = m.where("copies > 1").select("rep", "id")
    across = (
        links.select("rep_a", "rep_b")
        .join(several.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a", "left")
        .join(several.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b", "left")
        .select(F.coalesce("x", "rep_a").alias("x"), F.coalesce("y", "rep_b").alias("y"))
    )
    inside = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    both = across.unionByName(inside)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


# Legal forms and countries that don't tell companies apart; marks of gender in titles.
_LEGAL = r"(?iU)\b(ag|sa|gmbh|sàrl|sarl|sagl|s\.?a\.?r\.?l\.?|kg|ohg|ltd|llc|inc|se|plc|holding|genossenschaft|stiftung|fondation|fondazione|verein|coopérative|cooperativa|co|cie|comp|schweiz|suisse|svizzera|switzerland|svizra|swiss)\b\.?"
_GENDER = r"(?iU)[(\[]?\b[mwfhdxia](\s?[/|,]\s?[mwfhdxi*]){1,3}\b[)\]]?|\(\s*(a|all|alle|gn)\s*\)|[*:_/·]-?(in|innen|r|frau|euse|rice|trice|ière|e)\b|\((in|innen|e|r|ne|euse|trice|ière)\)"
_WORKLOAD = r"(?U)[,(]?\s*\b\d{1,3}\s*%?\s*(-|–|bis|à|a|to)?\s*(\d{1,3})?\s*%\s*\)?"
_PLACE = r"(?U)\s+(-|–|—|\||@)\s+\S.*$|\s+(in|à|a|at|im)\s+\p{Lu}.*$"


def company_key(name: Column) -> Column:
    """A company's name apart from case, spacing, legal form and country; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), _LEGAL, " "), r"(?U)[^\p{L}\p{N}]+", " ")
    plain = F.trim(plain)
    return F.when(plain != "", plain)


def title_key(title: Column) -> Column:
    """A title apart from case, spacing, gender marks, workload and place; null if nothing is left."""
    plain = F.regexp_replace(F.trim(title), _GENDER, " ")
    plain = F.regexp_replace(plain, _WORKLOAD, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), _PLACE, " ")
    plain = F.trim(F.regexp_replace(F.lower(plain), r"(?U)[^\p{L}\p{N}+#]+", " "))
    return F.when(plain != "", plain)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = texts(spark, sf_dir, "jobs", "id", "title", "company_name", "description_md")
    company, title = company_key(F.col("company_name")), title_key(F.col("title"))
    block = F.when(company.isNotNull() & title.isNotNull(), F.xxhash64(company, title))
    return jobs.select("id", block.alias("block"), F.col("description_md").alias("text"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(_jobs(spark, sf_dir), threshold=0.6, shingle=3, min_words=60)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of advertisements of one company and title that share at least 60 % of their wording."""
    return pairs(*_near(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per advertisement: its class of copies, its group of near-duplicates, its links."""
    links, members = _near(spark, sf_dir)
    return grouped(_jobs(spark, sf_dir).select("id"), links, members)


def grouped(records: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links, copies) of every id of records(id); one without features stands alone."""
    links = cut(links)
    groups = connected_components(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    placed = (
        members.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(ends, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )
    alone = records.select("id").distinct().join(members.select("id"), "id", "left_anti")
    one = F.lit(1).cast("long")
    return placed.unionByName(alone.select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), (one - 1).alias("links"), one.alias("copies")))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLE_SQL: dict[str, str] = {}
