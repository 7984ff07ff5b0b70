"""Filling fixed-capacity containers: best-fit decreasing over a segment tree.

Sizes are token counts of a public tokenizer, counted where the texts lie. A text longer than a
container is cut into full containers and a rest; the rest and all shorter texts are packed whole.
Items are spread over shards of about `shard_items` by a hash of the id, so that no task holds more
whatever the input, and each shard is packed by best-fit decreasing: items from large to small, each
into the tightest container it fits, found in a segment tree over the possible remaining capacities in
logarithmic time. Every shard leaves at most one container less than half full; the containers below
`refill_below` of all shards are taken apart and packed once more together (again in shards), so
that the loss doesn't grow with the number of shards.

Only ids and sizes are shuffled, never texts. Edge cases: null and empty texts (no tokens) take no
room and get no container; equal texts, repeated ids and null ids are packed each; ties go by id; an empty table gives an empty
result; a size equal to the capacity fills a container.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import cut, texts

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_encoders: dict[str, object] = {}


def _encoder(path: str):
    """A tokenizer read from a vocabulary file, once per Python worker."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the split of the rank files
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _encoders[path] = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(p) for p in pieces.encode(list(texts), num_threads=1)]
    return _encoders[path]


def token_counts(df: DataFrame, *, doc: tuple[str, str] = ("doc_id", "text"), tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    source = df.select(F.col(doc[0]).cast("long").alias("doc_id"), F.coalesce(F.col(doc[1]), F.lit("")).alias("text"))

    df.sparkSession.sparkContext.addFile(tokenizer)  # shipped, so that workers need no file of their own
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": encode(list(pdf["text"]))})

    return source.mapInPandas(count, "doc_id long, tokens long")


class OpenContainers:
    """Containers by remaining capacity, with a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        self.count = np.zeros(2 * self.leaves, np.int64).tolist()
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, container: int, remaining: int) -> None:
        self.open[remaining].append(container)
        node = remaining + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (container, remaining) with the least remaining capacity of at least `size`."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not self.count[node]:
                    node += 1
        remaining = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[remaining].pop(), remaining


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (0-based, dense); sizes are between 1 and capacity."""
    order = np.argsort(-sizes, kind="stable")
    tree = OpenContainers(capacity)
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            container, remaining = used, capacity
            used += 1
        else:
            container, remaining = found
        out[i] = container
        if remaining > size:
            tree.add(container, remaining - size)
    return out


_PACKED = "doc_id long, part int, size long, shard long, container long, fill long"


def _pack_shards(items: DataFrame, capacity: int, shard_items: int) -> DataFrame:
    """items(doc_id, part, size) → with shard, container (unique within the shard) and its fill."""
    total = items.count()
    shards = max(1, -(-total // shard_items))
    sharded = items.select("doc_id", "part", "size", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).alias("shard"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard is packed once it is complete."""
        kept: list[pd.DataFrame] = []
        current = None
        for pdf in batches:
            for shard, rows in pdf.groupby("shard", sort=False):
                if kept and shard != current:
                    yield _pack_one(pd.concat(kept), capacity)
                    kept = []
                current = shard
                kept.append(rows)
        if kept:
            yield _pack_one(pd.concat(kept), capacity)

    parts = min(shards, 1 << 14)
    ordered = sharded.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "part")
    return ordered.mapInPandas(pack, _PACKED)


def _pack_one(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    sizes = rows["size"].to_numpy()
    container = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(container, weights=sizes).astype(np.int64)
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "part": rows["part"].to_numpy(), "size": sizes, "shard": rows["shard"].to_numpy(), "container": container, "fill": fill[container]})


def pack(sizes: DataFrame, *, capacity: int = CAPACITY, shard_items: int = 50_000, refill_below: float = 0.98) -> DataFrame:
    """sizes(doc_id, tokens) → (doc_id, part, size, container_id): where each (part of an) item goes.

    `part` is 0 for whole items; items over the capacity have parts 0, 1, … of full containers and a rest.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    pieces = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    pieces = cut(pieces.select("doc_id", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("long").alias("size")))
    first = cut(_pack_shards(pieces, capacity, shard_items))
    good = first.where(F.col("fill") >= refill_below * capacity)
    again = _pack_shards(first.where(F.col("fill") < refill_below * capacity).select("doc_id", "part", "size"), capacity, shard_items)
    name = lambda df, mark: df.select("doc_id", "part", "size", F.concat_ws("-", F.lit(mark), "shard", "container").alias("container_id"))
    return name(good, "a").unionByName(name(again, "b"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` in containers of 2,048 tokens."""
    return pack(token_counts(texts(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {"p8_pack": p8_pack}
ORACLE_SQL: dict[str, str] = {}
