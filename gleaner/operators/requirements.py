"""Requirement levels named in advertisements: leadership, education, years, languages, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V
from gleaner.functions.text import as_lines, let, rx, strip_html


def _any_of(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def is_leadership(title: Column) -> Column:
    return F.coalesce(title.rlike(rx(V.LEADERSHIP_TITLE)), F.lit(False))


def is_senior(title: Column) -> Column:
    """Senior or specialist title, unless it is one for beginners."""
    return F.coalesce(title.rlike(rx(V.SENIOR_TITLE)) & ~title.rlike(rx(V.JUNIOR_TITLE)), F.lit(False))


def is_entry_friendly(description: Column) -> Column:
    return strip_html(description).rlike(rx(V.ENTRY_WELCOME))


def education(description: Column) -> tuple[Column, Column]:
    """(highest level named, whether softened within 120 characters); 'keine' if none is named."""
    return _education(strip_html(description))


def _education(text: Column) -> tuple[Column, Column]:
    level, soft = F.lit("keine"), F.lit(False)
    for name, pattern in reversed(V.EDUCATION_PATTERNS.items()):
        found = F.regexp_extract(text, rx(pattern), 0)
        at = F.regexp_instr(text, F.lit(rx(pattern)))  # of the match, not of its wording
        start = F.greatest(F.lit(1), at - 120)
        window = F.lower(F.substring(text, start, at + F.length(found) + 120 - start))
        hit = at > 0
        level = F.when(hit, name).otherwise(level)
        soft = F.when(hit, _any_of(window, V.SOFT_MARKERS)).otherwise(soft)
    return level, soft


def years_of_experience(description: Column) -> Column:
    """Digits or a German number word before 'Jahre Erfahrung'; null if none."""
    return _years(strip_html(description))


def _years(text: Column) -> Column:
    token = F.lower(F.regexp_extract(text, rx(V.YEARS), 1))
    words = F.create_map(*(F.lit(x) for kv in V.NUMBER_WORDS.items() for x in kv))
    return F.coalesce(token.try_cast("int"), F.try_element_at(words, token))


def clause_with(text: Column, pattern: str) -> Column:
    """The clause (line, list item, part between commas) in which the first match starts; null if none.

    The match is found in the whole text, so it may reach beyond the end of its clause.
    """
    at = F.regexp_instr(text, F.lit(rx(pattern)))
    before = F.element_at(F.split(F.substring(text, F.lit(1), at - 1), V.CLAUSE_END), -1)
    after = F.element_at(F.split(F.substring(text, at, F.length(text)), V.CLAUSE_END), 1)
    return F.when(at > 0, F.concat(before, after))


def required_languages(description: Column) -> Column:
    """map<language, 0.0 wished | 0.5 working language | 1.0 demanded>, by the clause that names it."""
    return _required_languages(as_lines(description))


def _required_languages(text: Column) -> Column:
    entries = []
    for lang, pattern in V.REQUIRED_LANGUAGES.items():
        entries.append(let(F.lower(clause_with(text, pattern)), _leveller(lang)))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _leveller(lang: str):
    def level(clause: Column) -> Column:
        value = F.when(_any_of(clause, V.SOFT_MARKERS), 0.0).when(_any_of(clause, V.HARD_MARKERS), 1.0).otherwise(0.5)
        return F.when(clause.isNotNull(), F.struct(F.lit(lang).alias("key"), value.alias("value")))

    return level


def further_education(description: Column) -> tuple[Column, Column]:
    """(wording of a demanded further education, softened); null where the clause is an offer."""
    return _further_education(as_lines(description))


def _further_education(lines: Column) -> tuple[Column, Column]:
    clause = clause_with(lines, V.FURTHER_EDUCATION)
    lower = F.lower(clause)
    wanted = clause.isNotNull() & ~_any_of(lower, V.EDUCATION_OFFER_MARKERS)
    return F.when(wanted, F.regexp_extract(lines, rx(V.FURTHER_EDUCATION), 0)), F.when(wanted, _any_of(lower, V.SOFT_MARKERS))


def requirements(title: Column, description: Column) -> Column:
    """All of it as one struct; tags are taken off once."""
    prepared = F.struct(strip_html(description).alias("plain"), F.coalesce(as_lines(description), F.lit("")).alias("lines"))
    return let(prepared, lambda x: _requirements(title, x["plain"], x["lines"]))


def _requirements(title: Column, plain: Column, lines: Column) -> Column:
    level, soft = _education(plain)
    further, further_soft = _further_education(lines)
    return F.struct(
        is_leadership(title).alias("is_leadership"),
        is_senior(title).alias("is_senior"),
        plain.rlike(rx(V.ENTRY_WELCOME)).alias("is_entry_friendly"),
        level.alias("education"),
        soft.alias("education_is_soft"),
        F.when(level == "keine", further).alias("further_education"),
        F.when(level == "keine", further_soft).alias("further_education_is_soft"),
        _years(plain).alias("years"),
        _required_languages(lines).alias("languages"),
    )
