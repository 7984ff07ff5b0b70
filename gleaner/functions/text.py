"""Text cleaning and normalisation as Column expressions.

Python-like semantics: patterns are Unicode-aware and case-insensitive through `rx`, since Java's
`\\w`, `\\b`, `\\s` are ASCII by default. Null stays null unless a function says otherwise.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed_values as V

_ENTITIES = {k.rstrip(";"): v for k, v in html5.items() if k.endswith(";") and len(v) == 1 and (ord(v) < 0x180 or k in ("ndash;", "mdash;", "hellip;", "bull;", "middot;", "euro;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "nbsp;"))}


def rx(pattern: str) -> str:
    """A pattern as Python's `re` would read it with IGNORECASE."""
    return f"(?iU){pattern}"


def let(value: Column, f) -> Column:
    """f(value) with `value` computed once: expressions inside lambdas are otherwise computed per element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space (also no-break spaces) become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column) -> Column:
    """Tags become spaces, white space collapses; null gives ''. Entities and script bodies stay."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def as_lines(c: Column) -> Column:
    """Like `strip_html`, but block tags become line breaks and lines are kept."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), rx(V.BLOCK_TAG), "\n")
    return F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"(?U)[^\S\n]+", " ")


def unescape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, V.MARKDOWN_ESCAPE, "$1")


def unescape_entities(c: Column) -> Column:
    """Decimal, hexadecimal and the Latin named character references; others stay.

    Splits at `&`, so that texts without one cost a single test.
    """
    names = F.create_map(*(F.lit(x) for kv in _ENTITIES.items() for x in kv))

    def decode(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#\d{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        code = F.when(name.rlike(r"^#\d"), F.substring(name, F.lit(2), F.length(name)).try_cast("int")).when(
            name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).try_cast("int")
        )
        char = F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(names, name))
        return F.when((name != "") & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    pieces = F.split(c, "&")
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decode), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def normalize_title(title: Column, city: Column | None = None) -> Column:
    """Comparable core of a title: entities, gender marks, workload, place and slogans removed; lower."""
    t = F.regexp_replace(unescape_entities(title), rx(V.GENDER_SUFFIX), "$1")
    t = F.regexp_replace(t, rx(V.TITLE_NOISE), " ")
    t = F.replace(F.replace(t, F.lit("*"), F.lit("")), F.lit("(in)"), F.lit(""))
    for _ in range(3):
        t = F.regexp_replace(t, rx(V.TITLE_TAIL), "")
    if city is not None:
        named = F.concat(F.lit(r"(?iU)\b\Q"), city, F.lit(r"\E\b"))
        t = F.when(F.coalesce(city, F.lit("")) != "", F.regexp_replace(t, named, F.lit(" "))).otherwise(t)
    return F.lower(F.btrim(collapse(t), F.lit(V.TITLE_EDGE)))


def normalize_company(name: Column) -> Column:
    """Company name without legal form, group words and punctuation; lower."""
    t = F.regexp_replace(name, rx(V.LEGAL_FORM), " ")
    return F.lower(collapse(F.regexp_replace(t, r"(?U)[^\w\s]", " ")))


def reconcile_workload(title: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """(min, max, from_title): a workload in the title outside the stated range replaces it."""
    a = F.regexp_extract(title, V.TITLE_WORKLOAD, 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(title, V.TITLE_WORKLOAD, 2).try_cast("int"), a)
    valid = a.isNotNull() & (a <= b) & a.between(1, 100) & b.between(1, 100)
    replace = F.coalesce(lo.isNotNull() & hi.isNotNull() & valid & ~((lo <= a) & (b <= hi)), F.lit(False))
    return F.when(replace, a).otherwise(lo), F.when(replace, b).otherwise(hi), replace


def dedup_block(postal_code: Column, city: Column) -> Column:
    """Postal code, else lower city, else '?'; empty counts as missing."""
    return F.coalesce(F.nullif(postal_code, F.lit("")), F.nullif(F.lower(city), F.lit("")), F.lit("?"))


def known_postal_code(c: Column) -> Column:
    """The code, or null for what merely stands in for one: no digit but zeros ('k.A.', '0000', '-')."""
    return F.when(c.rlike("[1-9]"), F.trim(c))


def content_hash(title_key: Column, description: Column) -> Column:
    """First 32 hex digits of SHA-256 over title key and stripped description."""
    return F.substring(F.sha2(F.concat(F.coalesce(title_key, F.lit("")), F.lit("|"), F.lower(strip_html(description))), 256), 1, 32)


def shingles(c: Column, size: int = V.SHINGLE_WORDS) -> Column:
    """Distinct word n-grams of the stripped lower text; fewer words give one, none gives an empty array."""
    none = F.array().cast("array<string>")

    def grams(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(F.size(words) == 0, none).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))

    return let(F.filter(F.split(F.lower(strip_html(c)), " "), lambda w: w != ""), grams)


def url_key(url: Column) -> Column:
    """Lower host without www. and path without a final slash; null without a host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", "")
    path = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(host, path))


def is_truncated(description: Column, description_url: Column, source_url: Column) -> Column:
    """The description lies on another host, or its stripped text is short."""
    a = F.lower(F.try_parse_url(description_url, F.lit("HOST")))
    b = F.lower(F.try_parse_url(source_url, F.lit("HOST")))
    return F.coalesce(a != b, F.lit(False)) | (F.length(strip_html(description)) < V.TRUNCATED_BELOW)


def truncate(c: Column, limit: int = 6000) -> Column:
    return F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, limit)


def snippet(c: Column, limit: int = 260) -> Column:
    """Head of the stripped text, cut at a space if one lies beyond 60 % of the limit, with ' …'."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit)
        at_space = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
        whole = F.when(F.length(at_space) > 0.6 * limit, at_space).otherwise(head)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(whole, F.lit(" ,;.")), F.lit(" …")))

    return let(unescape_markdown(strip_html(c)), cut)


def short(c: Column, limit: int = 90) -> Column:
    """One line for a table cell: unescaped, collapsed, pipes to slashes, cut to `limit` with '…'."""
    t = collapse(F.translate(unescape_markdown(F.coalesce(c, F.lit(""))), "|", "/"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def quote(text: Column, pattern: str, window: int = 45) -> Column:
    """The first match with up to `window` characters on each side, cut at spaces, with ellipses."""
    t = strip_html(text)
    found = F.regexp_extract(t, rx(pattern), 0)
    at = F.nullif(F.regexp_instr(t, F.lit(rx(pattern))), F.lit(0))
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(t), at + F.length(found) - 1 + window)
    raw = F.substring(t, start, end - start + 1)
    left = F.when(start > 1, F.concat(F.lit("… "), F.regexp_replace(raw, r"^\S*\s", ""))).otherwise(raw)
    both = F.when(end < F.length(t), F.concat(F.regexp_replace(left, r"\s\S*$", ""), F.lit(" …"))).otherwise(left)
    return F.when(at.isNotNull(), both)


def extract_relevant(description: Column) -> Column:
    """From the first task or requirement heading up to the first benefit or contact heading after
    the last of them; a text without such a heading, or with nothing left, stays as it is."""
    def cut(x: Column) -> Column:
        lines, kinds = x["lines"], x["kinds"]
        first = F.array_position(kinds, 1)
        last = F.array_max(F.zip_with(kinds, F.sequence(F.lit(1), F.size(kinds)), lambda k, i: F.when(k == 1, i).otherwise(0)))
        after = F.array_position(F.slice(kinds, last + 1, F.size(kinds)), 2)
        stop = F.when(after > 0, (last + after - 1).cast("int")).otherwise(F.size(kinds))
        kept = F.trim(F.array_join(F.slice(lines, first.cast("int"), stop - first.cast("int") + 1), "\n"))
        return F.when((first > 0) & (kept != ""), kept).otherwise(description)

    def sort(lines: Column) -> Column:
        kinds = F.transform(lines, lambda s: F.when(s.rlike(rx(V.SECTION_START)), 1).when(s.rlike(rx(V.SECTION_END)), 2).otherwise(0))
        return F.struct(lines.alias("lines"), kinds.alias("kinds"))

    return let(let(F.split(description, "\n"), sort), cut)


def job_text(title: Column, company: Column, description: Column, chars: int = 2500) -> Column:
    """Text to embed: title, 'title bei company.', and the head of the relevant description."""
    body = F.substring(strip_html(extract_relevant(description)), 1, chars) if chars else F.lit("")
    return F.concat_ws("\n\n", title, F.concat(title, F.lit(" bei "), company, F.lit(".")), F.nullif(body, F.lit("")))


def workload_label(lo: Column, hi: Column) -> Column:
    both = F.concat(lo.cast("string"), F.when(lo == hi, F.lit("")).otherwise(F.concat(F.lit("-"), hi.cast("string"))), F.lit("%"))
    return F.when(lo.isNull() & hi.isNull(), F.lit("offen")).otherwise(F.coalesce(both, F.concat(F.coalesce(lo, hi).cast("string"), F.lit("%"))))


def date_label(day: Column) -> Column:
    """German weekday and dd.MM.yyyy."""
    names = F.array(*(F.lit(x) for x in ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")))
    return F.concat(F.element_at(names, F.weekday(day) + 1), F.lit(", "), F.date_format(day, "dd.MM.yyyy"))


def safe_id(c: Column) -> Column:
    """An id that is safe as a file name."""
    return F.replace(F.replace(c, F.lit("/"), F.lit("_")), F.lit(".."), F.lit("_"))
