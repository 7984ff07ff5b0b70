"""Language of documents and of passages in another language, by error-correcting output codes.

Every language has a codeword; each bit of the code splits the languages in two and is predicted by a
binary naive Bayes classifier on character 3- and 4-grams (hashed). A text gets the language whose
codeword has the least loss, log(1 + exp(-bit x margin)), the bits weighted by their accuracy on the
training rows. The confidence is the softmax of the losses. A decision is flagged as ambiguous below `sure`, and
where the signs of its bits are no nearer to the language's codeword than to another one.

Training rows come from the labelled rows themselves: at most `per_language` of each label with 80 to
`max_chars` characters (documented bounds; whole texts, those with the smallest hash of the id among twice as
many), whose labels may be partly wrong: after a first fit the rows that the model contradicts are left
out and it is fitted again. The choice reads ids and labels only. A few words of each
language are always among them, so that an empty table still gives a model.

Texts lose their markup and code and are cut into sentences and list items. Every cut is scored; the main
language is that of the whole text, and a passage is a run of at least `min_units` neighbouring
cuts that are sure to be in one other language, as is their sum.

A run of at least twice as many items, too short each, counts where it has words enough and its sum is sure.

Edge cases: null, blank and letterless texts have no language (null, confidence 0) and no passages;
a single foreign sentence, slogan or word is no passage; labels that name no known language count as
missing; repeated rows are treated alike; empty tables give empty results; very long texts are
processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.markup import HEADING, HOLD, HOLD_END, ITEM, LINK, LINK_END, QUOTE, ROW, lex
from gleaner.session import texts

LANGUAGES = ("de", "fr", "it", "en")
BUCKET_BITS = 15
TEMPERATURE = 6.0  # neighbouring n-grams repeat each other's evidence

# A few frequent words of each language, and the spellings of labels.
SEEDS = {
    "de": "der die das und in zu mit für von auf ist im den dem des ein eine einen wir sie als nach bei aus nicht auch werden oder sowie über unsere ihre haben sind",
    "fr": "le la les de des du et en un une pour dans que qui sur avec est sont nous vous votre vos notre nos par au aux ou plus ainsi être avoir cette",
    "it": "il lo la i gli le di del della dei delle e in un una per con che sono è nel nella si da al alla ai come più anche siamo avete vostro nostro",
    "en": "the of and to in a for with is on as by at an be are this that from or you your we our will have has their they which not can more",
}
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "tedesco", "gsw"],
    "fr": ["fr", "fra", "fre", "french", "französisch", "franzoesisch", "français", "francais", "francese"],
    "it": ["it", "ita", "italian", "italienisch", "italiano", "italien"],
    "en": ["en", "eng", "english", "englisch", "anglais", "inglese"],
}

_MARKS = re.compile(f"[{HEADING}{ITEM}{QUOTE}{ROW}]")
_HELD = re.compile(rf"{HOLD}(\d+){HOLD_END}")
_NOT_TEXT = re.compile(r"(?:https?://|www\.)\S+|\S+\s?(?:@|[\[(]at[\])])\s?\S+|\S+ at \S+(?: dot \S+)+")
_CUT = re.compile(r"\n+|(?<=[.!?…])\s+(?=[\"«„]?[A-ZÀ-Þ])|\s;\s")
_WORDS = re.compile(r"[^\W\d_]+")


def codewords(n: int) -> np.ndarray:
    """The exhaustive code of n classes: every way to split them in two once, as ±1 (classes x bits)."""
    columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
    return np.array(columns, dtype=np.float64).T


CODE = codewords(len(LANGUAGES))


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all 3- and 4-grams of all texts, and the number of n-grams of each text."""
    joined = "".join(f" {t.lower()}  " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = (codes > 191) | ((codes > 96) & (codes < 123))
    c = np.where(letter & (codes != 215) & (codes != 247) & (codes < 0x2000), codes, 32).astype(np.uint64)
    lengths = np.array([len(t.lower()) + 3 for t in texts])
    p1, p2, p3, p4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    tri = c * p1
    tri[:-1] += c[1:] * p2
    tri[:-2] += c[2:] * p3
    four = tri.copy()
    four[:-3] += c[3:] * p4
    shift = np.uint64(64 - BUCKET_BITS)
    mix = np.uint64(0xFF51AFD7ED558CCD)
    a = ((tri ^ (tri >> np.uint64(31))) * mix >> shift).astype(np.int64)
    b = ((four ^ (four >> np.uint64(29))) * mix >> shift).astype(np.int64) + (1 << BUCKET_BITS)
    # runs of blanks, and n-grams that would reach into the next text, say nothing
    blank = c == 32
    idle = blank.copy()
    idle[:-1] &= blank[1:]
    a[idle] = 2 << BUCKET_BITS
    b[idle] = 2 << BUCKET_BITS
    return np.stack((a, b), axis=1), lengths


class LanguageModel:
    """Weights of the bit classifiers (2 * buckets + 1 idle row, by bit) and the bits' weights."""

    def __init__(self, texts: list[str], labels: list[int]):
        labels = np.asarray(labels)
        counts = np.zeros((len(LANGUAGES), (2 << BUCKET_BITS) + 1))
        for k in range(len(LANGUAGES)):
            own = [t for t, y in zip(texts, labels) if y == k]
            if own:
                grams, _ = ngram_buckets(own)
                counts[k] = np.bincount(grams.ravel(), minlength=counts.shape[1])
        shares = counts[:, :-1] / np.maximum(1.0, counts[:, :-1].sum(axis=1, keepdims=True))  # languages count alike
        weights = np.zeros((counts.shape[1], CODE.shape[1]), np.float32)
        smooth = 2e-6
        for bit in range(CODE.shape[1]):
            plus, minus = shares[CODE[:, bit] > 0].mean(axis=0), shares[CODE[:, bit] < 0].mean(axis=0)
            weights[:-1, bit] = np.clip(np.log((plus + smooth) / (minus + smooth)), -4, 4)
        self.weights = weights
        self.bit_weights = np.ones(CODE.shape[1])
        margins = self.margins(texts)
        right = np.sign(margins) == CODE[labels]
        accuracy = np.clip(right.mean(axis=0), 0.5, 0.999)
        self.bit_weights = np.log(accuracy / (1 - accuracy)) + 1e-3

    def margins(self, texts: list[str]) -> np.ndarray:
        """Summed and tempered log-odds of every bit for each text."""
        if not texts:
            return np.zeros((0, CODE.shape[1]))
        grams, lengths = ngram_buckets(texts)
        per_place = self.weights[grams[:, 0]] + self.weights[grams[:, 1]]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        return np.add.reduceat(per_place, starts, axis=0, dtype=np.float64) / TEMPERATURE

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: softmax of the negative weighted losses to each codeword."""
        losses = np.logaddexp(0.0, -margins[:, None, :] * CODE[None, :, :]) @ (self.bit_weights / self.bit_weights.sum())
        scaled = -losses * CODE.shape[1]
        e = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[int]) -> LanguageModel:
    """Fits twice: rows that the first model contradicts are left out of the second."""
    seeds, seed_labels = [SEEDS[k] for k in LANGUAGES], list(range(len(LANGUAGES)))
    first = LanguageModel(texts + seeds, list(labels) + seed_labels)
    if not texts:
        return first
    guess = first.decode(first.margins(texts)).argmax(axis=1)
    kept = [i for i, y in enumerate(labels) if guess[i] == y]
    return LanguageModel([texts[i] for i in kept] + seeds, [labels[i] for i in kept] + seed_labels)


def units(text: str) -> list[str]:
    """Sentences and list items of a text without markup, code, links and mailboxes."""
    lexed = lex(text)
    t = _HELD.sub(" ", lexed.text).replace(LINK, "").replace(LINK_END, "")
    if "@" in t or "://" in t or "www." in t or "at)" in t or "at]" in t or " at " in t:
        t = _NOT_TEXT.sub(" ", t)
    return [u for u in (_MARKS.sub(" ", s).strip() for s in _CUT.split(t)) if u]


def tied(margins: np.ndarray, main: int) -> bool:
    """Whether the bits, by their signs, agree with another codeword as often as with that of `main`."""
    agreeing = (np.sign(margins)[None, :] == CODE).sum(axis=1)
    return bool((np.delete(agreeing, main) >= agreeing[main]).any())


def label_texts(texts: list[str | None], model: LanguageModel, *, sure: float = 0.8, min_units: int = 2, min_words: int = 4) -> list[tuple]:
    """(language, confidence, ambiguous, passages) of each text; passages are (language, confidence, units, text)."""
    cuts = [units(t) if t and not t.isspace() else [] for t in texts]
    flat = [u for c in cuts for u in c]
    margins = model.margins(flat)
    probabilities = model.decode(margins) if flat else margins
    best = probabilities.argmax(axis=1) if flat else np.empty(0, int)
    out, at = [], 0
    for c in cuts:
        lo, at = at, at + len(c)
        total = margins[lo:at].sum(axis=0, keepdims=True) if c else None
        if total is None or not total.any():
            out.append((None, 0.0, True, []))
            continue
        own = model.decode(total)[0]
        main = int(own.argmax())
        passages = _passages(c, margins[lo:at], probabilities[lo:at], best[lo:at], main, model, sure, min_units, min_words)
        out.append((LANGUAGES[main], float(own[main]), bool(own[main] < sure) or tied(total[0], main), passages))
    return out


def _passages(cut: list[str], margins: np.ndarray, probabilities: np.ndarray, best: np.ndarray, main: int, model: LanguageModel, sure: float, min_units: int, min_words: int) -> list[tuple]:
    if not (best != main).any():
        return []
    found = []
    i = 0
    while i < len(cut):
        k = int(best[i])
        if k == main:
            i += 1
            continue
        j, members = i, []
        while j < len(cut):
            if int(best[j]) == k:
                members.append(j)
            elif probabilities[j, int(best[j])] >= sure and len(_WORDS.findall(cut[j])) >= 2:
                break
            j += 1
        full = [m for m in members if probabilities[m, k] >= sure and len(_WORDS.findall(cut[m])) >= min_words]
        if len(full) < min_units:
            # items too short to be sure each may be so together, if there are enough words
            short = [m for m in members if len(_WORDS.findall(cut[m])) < min_words]
            words = sum(len(_WORDS.findall(cut[m])) for m in members)
            if len(short) + len(full) >= 2 * min_units and words >= 2 * min_units * min_words:
                full = members
        if len(full) >= min_units:
            p = model.decode(margins[members].sum(axis=0, keepdims=True))[0]
            if int(p.argmax()) == k and p[k] >= sure:
                found.append((LANGUAGES[k], float(p[k]), len(full), " ".join(cut[m] for m in members)))
        i = max(j, i + 1)
    return found


def known_label(label: Column) -> Column:
    """The language that a label names, whatever its spelling; null for none."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(plain.isin(names), lang).otherwise(out)
    return out


def train(rows: DataFrame, *, per_language: int = 400, max_chars: int = 20_000) -> LanguageModel:
    """A model from rows(id, label, text), label one of LANGUAGES or null.

    At most `per_language` rows of each label reach the driver, none longer than `max_chars`. The labels of an
    id that is there several times are each used.
    """
    labelled = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull()).select("id", "label").distinct()
    order = Window.partitionBy("label").orderBy("h", "id")
    first = labelled.withColumn("h", F.xxhash64("id")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * per_language)
    chosen = [r.id for r in first.select("id").distinct().collect()]
    if not chosen:
        return fit([], [])
    fitting = rows.where(F.col("id").isin(chosen) & F.col("label").isNotNull() & F.length("text").between(80, max_chars))
    texts_ = fitting.groupBy("label", "id").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("id"))
    picked = texts_.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "label", "text").collect()
    picked = sorted((r.id, r.label, r.text) for r in picked)
    return fit([" ".join(units(t)) for _, _, t in picked], [LANGUAGES.index(k) for _, k, _ in picked])


def languages_of(df: DataFrame, model: LanguageModel, *, key: str, text: str, sure: float = 0.8) -> DataFrame:
    """(key, lang, confidence, ambiguous, passages array<struct<lang, confidence, units, text>>) of each row."""
    source = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = source.schema["__key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                done = label_texts([t if isinstance(t, str) else None for t in part["__text"]], shared.value, sure=sure)
                yield pd.DataFrame(
                    {
                        key: part["__key"].to_numpy(),
                        "lang": [d[0] for d in done],
                        "confidence": [d[1] for d in done],
                        "ambiguous": [d[2] for d in done],
                        "passages": [[{"lang": p[0], "confidence": p[1], "units": p[2], "text": p[3]} for p in d[3]] for d in done],
                    }
                )

    return source.mapInPandas(scan, f"`{key}` {kind}, lang string, confidence double, ambiguous boolean, passages array<struct<lang:string,confidence:double,units:int,text:string>>")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = texts(spark, sf_dir, "jobs", "id", "description_language", "description_md")
    return jobs.select("id", known_label(F.col("description_language")).alias("label"), F.col("description_md").alias("text"))


_models: dict[tuple, LanguageModel] = {}


def _model(spark: SparkSession, sf_dir: str, jobs: DataFrame) -> LanguageModel:
    """Fitted once for the files of a folder: the queries on a table share it within a session."""
    key = (spark.sparkContext.applicationId, tuple(sorted(jobs.inputFiles())))
    if key not in _models:
        _models.clear()
        _models[key] = train(jobs)
    return _models[key]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    model = _model(spark, sf_dir, jobs)
    # the label rides along in the key, which spares a join
    keyed = jobs.select(F.struct("id", "label").alias("k"), "text")
    found = languages_of(keyed, model, key="k", text="text")
    return found.select("k.id", "k.label", "lang", "confidence", "ambiguous", "passages")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label does not name the main language, or with passages in another one."""
    done = _labelled(spark, sf_dir).where(F.col("lang").isNotNull())
    wrong = ~F.col("label").eqNullSafe(F.col("lang"))
    spoken = F.array_distinct(F.concat(F.array("lang"), F.transform("passages", lambda p: p["lang"])))
    return done.where(wrong | (F.size(spoken) > 1)).select("id", F.explode(spoken).alias("lang")).distinct()


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each record."""
    return _labelled(spark, sf_dir).select("id", "label", "lang", F.round("confidence", 6).alias("confidence"), "ambiguous", F.size("passages").alias("passages"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each passage in another language."""
    return _labelled(spark, sf_dir).select("id", F.posexplode("passages").alias("passage", "p")).select("id", "passage", "p.lang", F.round("p.confidence", 6).alias("confidence"), "p.units", "p.text")


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels, "p6_passages": p6_passages}
ORACLE_SQL: dict[str, str] = {}
