"""Language by stop-word counts, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.text import let


def detect_language(text: Column) -> Column:
    """The language with the most stop words; null below 5 hits or within 1.5 times the second.

    Words are taken out of the text once, and the counts are ranked once (`let`).
    """

    def hits(words: Column, stop: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(stop)))

    def ranked(words: Column) -> Column:
        counts = (F.struct(hits(words, stop.split()).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, stop) in enumerate(V.STOP_WORDS.items()))
        return F.reverse(F.array_sort(F.array(*counts)))

    def decided(r: Column) -> Column:
        best, second = r[0], r[1]
        clear = (best["n"] >= V.LANGUAGE_MIN_HITS) & ((second["n"] == 0) | (best["n"] >= second["n"] * V.LANGUAGE_MIN_RATIO))
        return F.when(clear, best["lang"])

    words = F.regexp_extract_all(F.lower(F.substring(text, 1, V.LANGUAGE_SAMPLE_CHARS)), F.lit(r"[a-zà-öø-ÿ]+"), 0)
    return F.when(text.isNotNull(), let(let(words, ranked), decided))


def matches_language(detected: Column, wanted: list[str]) -> Column:
    """No wish or no finding matches everything."""
    return F.lit(True) if not wanted else detected.isNull() | detected.isin(wanted)
