"""Passages of held-out items inside a corpus, by one Aho-Corasick scan over normalised text.

Texts are normalised to words: compatibility forms composed, invisible characters removed, case
folded, everything but letters and digits a separator. A leak is a run of at least `min_words` (w)
words that stand in the same order in an item. Every run of w words covers a whole block of
w // 2 words that starts at a multiple of w - w // 2 + 1 in the item, so the automaton holds only
these blocks; it reports where one occurs, and the run is then extended word by word in both
directions and kept if it is long enough. Offsets are mapped back to the original text.

A run that an earlier hit has found is not walked again, so that a scan is linear in the text. Items are
collected to build an automaton only within `max_items` and `max_chars` (both counted before); a larger set
gets several, and one pass of rolling block hashes over the corpus picks the documents for each. The
corpus is read where it lies, without a shuffle.

Edge cases: null or blank texts and items shorter than `min_words` words leak nothing; an item whose
passage occurs several times in a document gives one row per maximal run (`leaks`) or one pair
(`leaked_pairs`); equal items are each reported; an empty item table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import cut, table, texts

MIN_WORDS = 12
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(f"[^\\W_](?:[{INVISIBLE}̀-ͯ]*[^\\W_])*[̀-ͯ]*")


def normalise(text: str) -> str:
    """Words separated and enclosed by single spaces."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = _GAP.sub(" ", text.casefold())
    return f" {text.strip()} "


def words_with_offsets(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and their places (start, end) in the original text."""
    words: list[str] = []
    places: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        for w in normalise(m.group()).split():
            words.append(w)
            places.append(m.span())
    return words, places


class LeakScanner:
    """The automaton over the blocks of all items; built once per Python worker."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        import ahocorasick

        self.min_words = min_words
        self.block = max(1, min_words // 2)
        step = min_words - self.block + 1
        self.items = [(item_id, normalise(text).split()) for item_id, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words) >= min_words:
                for at in range(0, len(words) - self.block + 1, step):
                    found.setdefault(f" {' '.join(words[at:at + self.block])} ", []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for key, where in found.items():
            self.automaton.add_word(key, where)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, words) of every maximal run in the original text."""
        if self.empty or not text:
            return []
        plain = normalise(text)
        hits = list(self.automaton.iter(plain))
        if not hits:
            return []
        words, places = words_with_offsets(text)
        if len(words) != plain.count(" ") - 1:  # a rare form that composes across words: scan the words found
            plain = f" {' '.join(words)} "
            hits = list(self.automaton.iter(plain))
        runs = set()
        reached: dict[tuple[int, int], int] = {}  # how far a (item, diagonal) is known already
        counted = after = 0
        for end, where in hits:  # in order of `end`
            after += plain.count(" ", counted, end)  # words that end at or before this hit
            counted = end
            first = after - self.block
            for k, at in where:
                diagonal = (k, first - at)
                if reached.get(diagonal, -1) >= first + self.block:
                    continue
                item = self.items[k][1]
                a, b = first, at
                while a > 0 and b > 0 and words[a - 1] == item[b - 1]:
                    a, b = a - 1, b - 1
                y, z = first + self.block, at + self.block
                while y < len(words) and z < len(item) and words[y] == item[z]:
                    y, z = y + 1, z + 1
                reached[diagonal] = y
                if y - a >= self.min_words:
                    runs.add((self.items[k][0], places[a][0], places[y - 1][1], y - a))
        return sorted(runs)


def block_hashes(words: list[str], size: int, step: int = 1) -> np.ndarray:
    """64-bit hashes of the runs of `size` words that start at 0, step, 2 step, …"""
    if len(words) < size:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = h[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : len(h) - size + 1 + k] + (out >> np.uint64(29)))
    return out[::step]


_scanners: dict[str, LeakScanner] = {}


def _scanner(key: str, items: list[tuple[int, str]], min_words: int) -> LeakScanner:
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = LeakScanner(items, min_words)
    return _scanners[key]


def _split(items: DataFrame, max_items: int, max_chars: int) -> int:
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return max(1, -(-int(n) // max_items), -(-int(chars) // max_chars))


def _candidates(docs: DataFrame, items: DataFrame, parts: int, min_words: int) -> DataFrame:
    """docs(doc_id, text) → (doc_id, text, part) of the documents that hold a block of an item of that part.

    One pass over the corpus for any number of items: the hashes of the items' blocks (12 bytes each) go to
    the workers, a document's rolling hashes are looked up in them.
    """
    block = max(1, min_words // 2)
    step = min_words - block + 1

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(h, p) for t, p in zip(pdf["text"], pdf["part"]) for h in set(block_hashes(normalise(t).split(), block, step).tolist())]
            yield pd.DataFrame({"h": np.array([h for h, _ in found], np.uint64).view(np.int64), "part": np.array([p for _, p in found], np.int32)})

    numbered = items.select("text", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"))
    table_ = numbered.mapInPandas(cut_up, "h long, part int").distinct().orderBy("h", "part").toPandas()
    known = docs.sparkSession.sparkContext.broadcast((table_["h"].to_numpy(), table_["part"].to_numpy()))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, part = known.value
        for pdf in batches:
            at, to = [], []
            for i, t in enumerate(pdf["text"]):
                own = np.unique(block_hashes(normalise(t).split(), block).view(np.int64))
                lo, hi = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
                met = {int(p) for a, b in zip(lo[lo < hi], hi[lo < hi]) for p in part[a:b]}
                at += [i] * len(met)
                to += sorted(met)
            out = pdf.iloc[at].copy()
            out["part"] = to
            yield out

    return docs.mapInPandas(look_up, "doc_id long, text string, part int")


def leaks(docs: DataFrame, items: DataFrame, *, doc: tuple[str, str] = ("doc_id", "text"), item: tuple[str, str] = ("item_id", "text"), min_words: int = MIN_WORDS, max_items: int = 20_000, max_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, start_at, end_at, words): every maximal leaked run, with original offsets.

    `max_items` and `max_chars` bound one automaton (about 0.5 GB). More items are put into several; the corpus
    is then read once for the documents that hold a block of any item, and each automaton scans only its own.
    """
    docs = docs.select(F.col(doc[0]).cast("long").alias("doc_id"), F.col(doc[1]).alias("text")).where(F.length("text") > 0)
    items = items.select(F.col(item[0]).cast("long").alias("item_id"), F.col(item[1]).alias("text")).where(F.col("text").isNotNull())
    spark = docs.sparkSession
    parts = _split(items, max_items, max_chars)
    if parts > 1:
        docs = cut(_candidates(docs, items, parts, min_words))
    out = None
    for n in range(parts):
        of_part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == n)
        block = [(r.item_id, r.text) for r in of_part.orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(block)
        key = f"{id(shared)}-{n}-{len(block)}-{hash(tuple(block))}-{min_words}"

        def scan(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            scanner = _scanner(key, shared.value, min_words)
            for pdf in batches:
                rows = [(d, *run) for d, t in zip(pdf["doc_id"], pdf["text"]) for run in scanner.scan(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_at", "end_at", "words"])

        own = docs if parts == 1 else docs.where(F.col("part") == n)
        found = own.select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long, start_at int, end_at int, words int")
        out = found if out is None else out.unionByName(found)
    return out


def leaked_pairs(found: DataFrame) -> DataFrame:
    """Each affected document with each item it leaks, once."""
    return found.select("doc_id", "item_id").distinct()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(texts(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least twelve words in a row of an item's text, and the items they leak."""
    return leaked_pairs(_leaks(spark, sf_dir))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked run with its place in the original text."""
    return _leaks(spark, sf_dir)


# Runs of twelve words by equal joins; full-width and other compatibility forms are folded for letters and digits only.
P9_FOUND_SQL = f"""
WITH plain AS (
  SELECT kind, id, string_split(trim(regexp_replace(lower(replace(nfc_normalize(regexp_replace(text, '[{INVISIBLE}]', '', 'g')), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM eval_items) WHERE text IS NOT NULL
), runs AS (
  SELECT DISTINCT kind, id, list_aggregate(w[k : k + {MIN_WORDS - 1}], 'string_agg', ' ') AS run
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS k FROM plain)
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.kind = 'doc' AND i.kind = 'item' AND d.run = i.run
"""

QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}
ORACLE_SQL = {"p9_found": P9_FOUND_SQL}
