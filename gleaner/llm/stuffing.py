"""Keyword-stuffed pages and link lists, by rank-frequency curves and their divergence from prose.

1. One pass over the texts, where they lie: each page becomes its frequency spectrum (how many different
   words occur c times, function words apart from others), its links, and per sentence or line
   the numbers of function words, words repeated all over the page, links and tags, separators,
   codes and other words. Texts are never shuffled; what is shuffled is the spectrum, a few rows a page.
2. Curves by SQL windows: the window over a page's spectrum gives the ranks; a line is fitted to log count
   over log rank (slope, residual), and the words' mass in each octave of ranks, function words
   apart from others, gives a distribution of `2 * BANDS` cells. Its Jensen-Shannon divergence from
   the middle distribution of the pages of the same language and comparable length (power of two)
   is the page's divergence. Slope, residual and divergence are set against the same pages.
   A page extreme in any of them is flagged; so is one too short for a curve, or with a noticeable
   share of links, which are no words of the curve.
3. Exact check of the flagged pages against "more than half": a two-state Markov chain (prose, stuffing)
   over a page's sentences and lines gives the likeliest reading. Its rates are those of the corpus:
   of what a first reading by `PRIOR` takes for stuffing in flagged pages, and for prose anywhere; the
   prior counts as `PRIOR_WORDS` further words on both sides, so that a small or clean table has rates too.

Only the reference table (languages x length classes, under 200 rows whatever the input) and one row of
rates reach the driver or are broadcast.

Edge cases: null and blank texts, texts without words and links, and null ids are never reported; rows that
share an id are measured each, exact repeats as one; pages of other languages are set against the
class they fall into; empty tables give an empty result; very long pages are processed whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import cut, texts

# Function words by language.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn als wie so auch nur noch schon nicht kein keine mehr sehr in im an am auf aus bei beim mit nach seit von vom zu zum zur für gegen ohne um durch über unter vor hinter zwischen während trotz bis ab er sie es wir ihr sich uns ihnen ihre ihren ihrem ihrer unser unsere unseren sein seine ist sind war waren wird werden wurde haben hat hatte kann können soll sollte sollten will wollen muss müssen darf dazu dabei damit davon daran darauf hier dort dann obwohl andere anderen alle jede jeder rund etwa pro erst gerade innerhalb",
    "fr": "le la les l de des du d un une et ou mais car que qui dont où si ne pas plus moins très en dans sur sous par pour avec sans chez entre vers à au aux ce cet cette ces son sa ses leur leurs notre nos votre vos il elle on nous vous ils elles se s est sont était être avoir ont a ai avez avons ainsi aussi même comme selon malgré depuis après avant pendant près quand certains certaines plusieurs beaucoup y n c qu",
    "it": "il lo la i gli le l un uno una di del dello della dei degli delle d a al allo alla ai agli alle da dal dalla dai dalle in nel nella nei nelle su sul sulla con per tra fra e ed o ma che chi cui se non più meno molto anche come quando dove noi voi loro si ci vi è sono era essere avere ha hanno abbiamo avete suo sua nostro nostra vostro vostra questo questa secondo senza dopo prima durante circa dovrebbe perché alcuni molte diverse",
    "en": "the a an of in on at to from by for with without about into over under between after before during since until and or but because if although while when as than that this these those it its he she they we you his her their our your is are was were be been being have has had do does did can could will would shall should may might must not no only also more most some any each every all other who which what where there so very",
}
_LANGS = tuple(FUNCTION_WORDS)
_SPOKEN: dict[str, tuple[int, ...]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _SPOKEN[_w] = (*(x for x in _SPOKEN.get(_w, ()) if x != _k), _k)

SUSPECT_Z = 1.5
NEAR_Z = 1.0
SHORT_WORDS = 64
FEW_FUNCTION_WORDS = 0.1
BANDS = 8
# Links outweigh other words from 17 % of a stretch on, and stuffing is half of a reported page.
LINK_SHARE = 0.08

_LINK_MD = re.compile(r"!?\[([^\[\]\n]*)\]\((\S*?)\)")
_LINK_HTML = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I)
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_CUT = re.compile(r"\n+|(?<=[.!?…])\s+(?=[\"„«]?[A-ZÀ-ÞŒ])")
_TOKEN = re.compile(r"(?:https?://|www\.)\S+|#\w[\w-]*|[^\W_]+(?:[-.][^\W_]+)*|[|•;·,]|->|»")
# The words and separators of a stretch without links and tags.
_PLAIN = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_SEPARATORS = ("|", "•", ";", "·", ",", "->", "»")
_OPEN, _CLOSE = "", ""

CLASSES = ("function", "repeated", "link", "separator", "code", "other")
FUNCTION, REPEATED, LINK, SEPARATOR, CODE, OTHER = range(len(CLASSES))
# What a stretch of stuffing and one of prose are made of, before a corpus is seen.
PRIOR = {"stuffing": (0.04, 0.45, 0.20, 0.30, 0.10, 0.31), "prose": (0.30, 0.10, 0.01, 0.02, 0.01, 0.57)}
PRIOR_WORDS = 20_000
SWITCH = 2.5
# The occurrences of one word are not independent of each other.
REPEATS = 0.9


def log_odds(stuffing: tuple | None = None, prose: tuple | None = None) -> np.ndarray:
    """Log-odds of stuffing against prose of each class, from class counts of both and the prior."""
    rates = []
    for seen, name in ((stuffing, "stuffing"), (prose, "prose")):
        before = np.array(PRIOR[name])
        counts = before * PRIOR_WORDS + (np.array(seen, float) if seen is not None else 0.0)
        rates.append(counts / counts.sum() * before.sum())
    return np.log(rates[0] / rates[1])


def _tokens(unit: str) -> tuple[list[str], int, int]:
    """Words, number of words in links and tags, number of separators of a stretch."""
    if _OPEN not in unit and _CLOSE not in unit and "#" not in unit and "://" not in unit and "www." not in unit:
        words = list(map(str.lower, _PLAIN.findall(unit)))
        return words, 0, sum(map(unit.count, _SEPARATORS))
    words, links, separators, inside = [], 0, 0, False
    for piece in re.split(f"([{_OPEN}{_CLOSE}])", unit) if _OPEN in unit or _CLOSE in unit else [unit]:
        if piece in (_OPEN, _CLOSE):
            inside = piece == _OPEN
            continue
        for tok in _TOKEN.findall(piece):
            first = tok[0]
            if first in "|•;·,->»":
                separators += 1
            elif inside or first == "#" or "://" in tok or tok.startswith("www."):
                links += 1
            else:
                words.append(tok.lower())
    return words, links, separators


def page_profile(text: str) -> tuple[Counter, np.ndarray] | None:
    """(counts of the words outside links, class counts per stretch), or None without words and links."""
    t = _LINK_MD.sub(lambda m: f"{_OPEN}{m[1]}{_CLOSE}", text)
    if "<" in t:
        t = _LINK_HTML.sub(lambda m: f"{_OPEN}{m[1]}{_CLOSE}", t)
        t = _TAG.sub(" ", t.replace("<br", "\n<br").replace("<li", "\n<li").replace("<LI", "\n<LI").replace("</p", "\n</p"))
    if "&" in t:
        t = t.replace("&nbsp;", " ").replace("&amp;", "&")
    lines = [u for u in _CUT.split(t) if u and not u.isspace()]
    distinct = dict.fromkeys(lines)
    for u in distinct:
        distinct[u] = _tokens(u)
    counts: Counter = Counter()
    for u in lines:
        counts.update(distinct[u][0])
    if not counts and not any(links for _, links, _ in distinct.values()):
        return None
    # a line that is there twice says nothing about its words
    once = counts if len(distinct) == len(lines) else Counter(w for words, _, _ in distinct.values() for w in words)
    often = max(3, 0.02 * sum(once.values()))
    kind = {w: FUNCTION if w in _SPOKEN else REPEATED if n >= often and not w.isdigit() else CODE if w.isdigit() and len(w) > 3 else OTHER for w, n in once.items()}
    rows = np.zeros((len(lines), len(CLASSES)), np.uint32)
    for i, u in enumerate(lines):
        words, links, separators = distinct[u]
        row = [0, 0, links, separators, 0, 0]
        for w in words:
            row[kind[w]] += 1
        rows[i] = row
    return counts, rows


def _as_evidence(rows: np.ndarray) -> np.ndarray:
    """Class counts with only the separators beyond the usual comma for every four words of a sentence."""
    out = rows.astype(np.float64)
    words = out[:, FUNCTION] + out[:, REPEATED] + out[:, CODE] + out[:, OTHER]
    out[:, SEPARATOR] = np.maximum(0.0, out[:, SEPARATOR] - words / 4)
    return out


def share_of(rows: np.ndarray, odds: np.ndarray) -> float:
    """Share of a page's words and links that stand in stuffing."""
    sizes = rows.sum(axis=1) - rows[:, SEPARATOR]
    stuffed = np.array(_likeliest((_as_evidence(rows) @ odds).tolist()), bool)
    return float(sizes[stuffed].sum() / max(1, sizes.sum()))


def stuffed_share(text: str, odds: np.ndarray | None = None) -> float:
    """Share of a page's words that stand in stuffing instead of sentences; by the prior without `odds`."""
    made = page_profile(text)
    return 0.0 if made is None else share_of(made[1], log_odds() if odds is None else odds)


def _likeliest(odds: list[float]) -> list[bool]:
    """Viterbi over the two states; `odds` favour stuffing where positive."""
    prose, stuff = 0.0, -1.0
    back = []
    for o in odds:
        to_prose = (stuff - SWITCH > prose)
        to_stuff = (prose - SWITCH > stuff)
        prose, stuff = (stuff - SWITCH if to_prose else prose), (prose - SWITCH if to_stuff else stuff) + o
        back.append((to_prose, to_stuff))
    state = stuff > prose
    out = []
    for to_prose, to_stuff in reversed(back):
        out.append(state)
        state = (not state) if (to_stuff if state else to_prose) else state
    return out[::-1]


def rank_bands(spectrum: dict[tuple[int, int], int]) -> list[float]:
    """Share of the words in each octave of ranks, first of function words, then of others."""
    mass, a = [0] * (2 * BANDS), 1
    for (c, own), v in sorted(spectrum.items(), reverse=True):
        b = a + v - 1
        for k in range(min(BANDS, a.bit_length()) - 1, min(BANDS, b.bit_length())):
            high = (2 << k) - 1 if k < BANDS - 1 else b
            mass[(0 if own else BANDS) + k] += (min(b, high) - max(a, 1 << k) + 1) * c
        a = b + 1
    return [x / max(1, sum(mass)) for x in mass]


_PROFILE = "doc_id long, h long, n long, links long, spoken array<long>, bands array<double>, spectrum array<struct<c:int,own:int,v:int>>, rows binary"


def page_profiles(pages: DataFrame) -> DataFrame:
    """pages(doc_id, text) → one row for every page with words or links, made where the page lies.

    `spectrum` says how many different words (`v`) of a kind (`own` 1: function words) occur `c` times.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, h, t in zip(pdf["doc_id"], pdf["h"], pdf["text"]):
                made = page_profile(t)
                if made is None:
                    continue
                counts, rows = made
                spoken = [0] * len(_LANGS)
                spectrum: Counter = Counter()
                for w, c in counts.items():
                    langs = _SPOKEN.get(w, ())
                    spectrum[c, 1 if langs else 0] += 1
                    for k in langs:
                        spoken[k] += c
                out.append((d, h, sum(counts.values()), int(rows[:, LINK].sum()), spoken, rank_bands(spectrum), [{"c": c, "own": o, "v": v} for (c, o), v in spectrum.items()], rows.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "h", "n", "links", "spoken", "bands", "spectrum", "rows"])

    source = pages.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return source.mapInPandas(make, _PROFILE)


def rank_frequency(profiles: DataFrame) -> DataFrame:
    """Profiles → one row per page with the fitted curve.

    Columns: doc_id, h, n (words), slope, residual, bands (see `rank_bands`), lang (that of most function words), length_class, link_share.
    A page whose words are function words of one language for less than `FEW_FUNCTION_WORDS` has no language. A page of links alone has n 0 and no length class. Only spectra are shuffled, once; ranks by a window
    and the fit need no further exchange. The sums over the ranks a … b of words with equal counts are
    integrals from a - 1/2 to b + 1/2.
    """
    facts = F.struct("n", "links", "spoken", "bands")
    no_word = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("own"), F.lit(0).alias("v")))
    # one entry without words carries what is known of the page already
    entries = profiles.select("doc_id", "h", facts.alias("page"), F.explode(F.concat("spectrum", no_word)).alias("e"))
    placed = entries.select("doc_id", "h", F.when(F.col("e.c") == 0, F.col("page")).alias("page"), "e.*").repartition("doc_id", "h")
    once = placed.groupBy("doc_id", "h", "c", "own").agg(F.first("v").alias("v"), F.first("page").alias("page"))
    down = Window.partitionBy("doc_id", "h").orderBy(F.col("c").desc(), F.col("own").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = once.withColumn("b", F.sum("v").over(down)).withColumn("a", F.col("b") - F.col("v") + 1)
    lo, hi, y = F.col("a") - 0.5, F.col("b") + 0.5, F.when(F.col("c") > 0, F.ln(F.col("c").cast("double")))
    first = lambda x: x * F.ln(x) - x
    second = lambda x: x * F.ln(x) * F.ln(x) - 2 * x * F.ln(x) + 2 * x
    ranked = ranked.withColumn("y", y).withColumn("x1", F.when(F.col("c") > 0, first(hi) - first(lo))).withColumn("x2", F.when(F.col("c") > 0, second(hi) - second(lo)))

    fit = ranked.groupBy("doc_id", "h").agg(
        F.max("page").alias("page"),
        F.sum("v").cast("double").alias("w"), F.sum("x1").alias("sx"), F.sum("x2").alias("sxx"),
        F.sum(F.col("v") * F.col("y")).alias("sy"), F.sum(F.col("v") * F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x1") * F.col("y")).alias("sxy"),
    )
    spread, off, both = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("w"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("w"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("w")
    slope = F.when((F.col("w") > 1) & (spread > 1e-9), both / spread)
    n = F.col("page.n")
    most = F.array_max("page.spoken")
    return fit.where("page IS NOT NULL").select(
        "doc_id",
        "h",
        n.alias("n"),
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.coalesce(F.sqrt(F.greatest(F.lit(0.0), (off - slope * both) / F.col("w"))), F.lit(0.0)).alias("residual"),
        F.col("page.bands").alias("bands"),
        F.when(most >= FEW_FUNCTION_WORDS * n, F.element_at(F.array(*(F.lit(k) for k in _LANGS)), F.array_position("page.spoken", most).cast("int"))).alias("lang"),
        F.when(n > 0, F.floor(F.log2(n.cast("double"))).cast("int")).alias("length_class"),
        (F.col("page.links") / (n + F.col("page.links"))).alias("link_share"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence (natural logarithm) of two distributions given as arrays of one length."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.ln(a / m)).otherwise(0.0) / 2 + F.when(b > 0, b * F.ln(b / m)).otherwise(0.0) / 2

    return F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)


MEASURES = ("slope", "residual", "divergence")
_CLASS = ("lang", "length_class")


def _own_share() -> Column:
    return F.aggregate(F.slice("bands", 1, BANDS), F.lit(0.0), lambda t, x: t + x)


def with_divergence(curves: DataFrame) -> DataFrame:
    """Adds `divergence`: Jensen-Shannon, from the middle distribution of prose of the page's language and length.

    Prose of a class are its pages whose share of function words is not far below the class: middle and
    scale of that share are inferred from its upper tail (75th and 90th percentile), as stuffing can only lower
    it. The divergence is positive for pages with fewer function words than that, else negative; a page
    of no language has the largest, log 2.
    """
    cells = range(2 * BANDS)
    placed = curves.withColumn("own", _own_share())
    known = placed.where(F.col("lang").isNotNull() & F.col("length_class").isNotNull())
    tail = known.groupBy(*_CLASS).agg(F.percentile_approx("own", 0.75, 1000).alias("u75"), F.percentile_approx("own", 0.90, 1000).alias("u90"))
    least = F.col("u75") - (F.col("u90") - F.col("u75")) * (0.674 + 2.0) / 0.607
    # at most 4 languages x 64 length classes
    prose = known.join(F.broadcast(tail), list(_CLASS)).where(F.col("own") >= least)
    middle = prose.groupBy(*_CLASS).agg(*(F.percentile_approx(F.col("bands")[i], 0.5, 1000).alias(f"q_{i}") for i in cells))
    total = F.nullif(sum((F.col(f"q_{i}") for i in cells), F.lit(0.0)), F.lit(0.0))
    usual = middle.select(*_CLASS, F.array(*(F.coalesce(F.col(f"q_{i}") / total, F.lit(0.0)) for i in cells)).alias("usual"))
    usual_own = F.aggregate(F.slice("usual", 1, BANDS), F.lit(0.0), lambda t, x: t + x)
    sign = F.when(F.col("own") < usual_own, 1.0).otherwise(-1.0)
    return placed.join(F.broadcast(usual), list(_CLASS), "left").withColumn("divergence", F.coalesce(sign * jensen_shannon(F.col("bands"), F.col("usual")), F.lit(math.log(2.0)))).drop("usual", "own")


def prose_reference(curves: DataFrame) -> DataFrame:
    """Middle and scale of each measure per language and length class; at most 4 x 64 rows.

    Slope and residual: median and median absolute deviation. Stuffing can only raise the
    divergence, and may be common in a class, so both are inferred from the lower tail: a normal
    curve through the 10th and 25th percentile.
    """
    keys = list(_CLASS)
    low, quarter = F.percentile_approx("divergence", 0.10, 10_000), F.percentile_approx("divergence", 0.25, 10_000)
    medians = curves.groupBy(*keys).agg(
        *(F.percentile_approx(m, 0.5, 10_000).alias(f"{m}_mid") for m in ("slope", "residual")),
        (quarter + (quarter - low) * 1.111).alias("divergence_mid"),
        ((quarter - low) / 0.607 / 1.4826).alias("divergence_off"),
    )
    near = curves.join(F.broadcast(medians), keys)
    return near.groupBy(*keys, *(f"{m}_mid" for m in MEASURES), "divergence_off").agg(
        *(F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_mid")), 0.5, 10_000).alias(f"{m}_off") for m in ("slope", "residual"))
    )


def scored(curves: DataFrame) -> DataFrame:
    """Curves with divergence, the z of each measure among pages of the language and length, and `flagged`."""
    known = cut(with_divergence(curves))
    z = known.join(F.broadcast(prose_reference(known)), list(_CLASS), "left")
    for m, floor in (("slope", 0.02), ("residual", 0.01), ("divergence", 0.004)):
        z = z.withColumn(f"z_{m}", (F.col(m) - F.col(f"{m}_mid")) / (F.greatest(F.col(f"{m}_off"), F.lit(floor)) * 1.4826))
    odd = (F.abs("z_slope") > 2 * SUSPECT_Z) | (F.col("z_residual") > 2 * SUSPECT_Z) | (F.col("n") < SHORT_WORDS)
    # what has clearly more function words than prose isn't stuffing, however odd its curve
    extreme = (F.col("z_divergence") > SUSPECT_Z) | (odd & (F.col("z_divergence") > -NEAR_Z))
    keep = ["doc_id", "h", "n", "lang", "length_class", *MEASURES, *(f"z_{m}" for m in MEASURES), "link_share"]
    return z.withColumn("flagged", F.coalesce(extreme, F.lit(True)) | (F.col("link_share") > LINK_SHARE)).select(*keep, "flagged")


def corpus_odds(profiles: DataFrame, flagged: DataFrame) -> np.ndarray:
    """Log-odds of the classes as the corpus has them: what the chain with the prior rates reads as stuffing in
    flagged pages, against what it reads as prose in all pages. One row reaches the driver."""
    odds = log_odds()
    n = len(CLASSES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, h, r in zip(pdf["doc_id"], pdf["h"], pdf["rows"]):
                seen = _as_evidence(np.frombuffer(r, np.uint32).reshape(-1, n))
                stuffed = np.array(_likeliest((seen @ odds).tolist()), bool)
                out.append((d, h, bool(stuffed.any()), seen[stuffed].sum(axis=0).tolist(), seen[~stuffed].sum(axis=0).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "h", "any", "stuffing", "prose"])

    read_so = cut(profiles.select("doc_id", "h", "rows").mapInPandas(read, "doc_id long, h long, any boolean, stuffing array<double>, prose array<double>"))
    sums = lambda name: [F.coalesce(F.sum(F.col(name)[i]), F.lit(0.0)).alias(f"{name}_{i}") for i in range(n)]
    prose = read_so.agg(*sums("prose")).first()
    stuffing = read_so.where("any").select("doc_id", "h", "stuffing").join(flagged, ["doc_id", "h"]).agg(*sums("stuffing")).first()
    found = log_odds(tuple(stuffing), tuple(prose))
    found[REPEATED] *= REPEATS
    return found


def stuffed_pages(pages: DataFrame, *, doc: tuple[str, str] = ("doc_id", "text"), threshold: float = 0.5) -> DataFrame:
    """(doc_id, stuffed_share): flagged pages whose words stand in stuffing for more than `threshold`."""
    profiles = cut(page_profiles(pages.select(F.col(doc[0]).cast("long").alias("doc_id"), F.col(doc[1]).alias("text"))))
    flagged = cut(scored(cut(rank_frequency(profiles))).where("flagged").select("doc_id", "h"))
    odds = corpus_odds(profiles, flagged)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = [share_of(np.frombuffer(r, np.uint32).reshape(-1, len(CLASSES)), odds) for r in pdf["rows"]]
            found = pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "stuffed_share": shares})
            yield found[found["stuffed_share"] > threshold]

    measured = profiles.select("doc_id", "h", "rows").mapInPandas(measure, "doc_id long, h long, stuffed_share double")
    return measured.join(flagged, ["doc_id", "h"]).select("doc_id", "stuffed_share").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of strung-together search words, names, links or tags."""
    return stuffed_pages(_pages(spark, sf_dir)).select("doc_id").distinct()


def p10_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted rank-frequency curve of every page, and how far it is from prose."""
    return scored(cut(rank_frequency(page_profiles(_pages(spark, sf_dir))))).drop("h")


QUERIES = {"p10_found": p10_found, "p10_curves": p10_curves}
ORACLE_SQL: dict[str, str] = {}
