"""Personal data in free text: found, listed, and replaced by typed placeholders.

Candidates come from their form (mailboxes, phone and identity numbers, streets with a number) or from capital
letters (names); what the corpus says about how strongly their terms reveal a person decides on them:

1. Every pair of capitalised words (and initial + word) is an observation of a term (the word in the
   first-name position) in a context (the words before it up to the last sentence end). It is
   *anchored* when a form of address stands before it or a part of it is in a mailbox of the text.
2. Over the whole corpus counts of (context, term) are summed. For a term t the disclosure is
   log2 P(anchored | t) / P(anchored), the pointwise mutual information with a protected person;
   terms above `min_bits` with at least `min_support` anchored observations reveal a person.
   A context reveals one if a large share of its observations hold a revealing term.
3. A text's words are then generalised to [NAME] where a revealing term, form of address or context
   together with the shape of a name exceeds the threshold.
4. Every longer number with its label (the words before it) is an observation too, whatever its form. It is anchored when a
   form of address or a mailbox stands near it. The disclosure of a label is the pointwise mutual information
   of the two, log2 P(anchored | label) / P(anchored). Where even its upper bound (two standard deviations) is
   below `clear_bits`, the label reveals no person (numbers of companies, articles, advertisements …), and what it
   labels stays as it is. For labels seen less than `min_label_support` times the fixed lists below decide.

The counts are summed within each batch before they are shuffled. The revealing terms and contexts
are sent to the workers only within `max_terms` (counted before); a larger lexicon is joined
to the texts' own terms instead.

Edge cases: null and empty texts give no findings and stay as they are; overlapping findings are
resolved by kind (mailbox, identity number, phone, address, name) and equal findings of a record
are listed once; repeated rows are treated alike; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import at_most, cut, texts

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Forms of address and titles, particles of surnames, labels, kinds of street.
TITLES = ["Herrn", "Herr", "Frau", "Hr.", "Fr.", "Dr.", "Dr", "Prof.", "Prof", "med.", "Madame", "Mademoiselle", "Monsieur", "Mme", "Mlle", "Maître", "Signora", "Signor", "signora", "signor", "Sig.ra", "Sig.", "Dott.ssa", "Dott.", "Mrs.", "Mrs", "Mr.", "Mr", "Ms.", "Ms", "Miss"]
PARTICLES = ["von", "van", "de", "di", "del", "della", "da", "du", "zu", "zur", "vom", "le", "la", "den", "der", "VON", "VAN", "DE", "DI", "DEL", "DELLA", "DA", "DU"]
ID_LABELS = ["AHV", "AVS", "SV", "Sozialversicherung", "Versicherten", "Versicherungs", "insurance", "security", "Ausweis", "Identitätskarte", "ID-Karte", "Pass", "passport", "passeport", "passaporto", "carte d'identité", "carta d'identità", "identity card", "assurance", "assicurazione"]
NOT_A_PERSONS_NUMBER = ["Artikel", "Art.", "article", "articolo", "EAN", "GTIN", "CHE-", "UID", "IDE", "IDI", "Referenz", "référence", "reference", "riferimento", "Ref.", "Stellennummer", "Job number", "d'annonce", "annuncio", "Inserat", "Bestellnummer", "Auftrag", "Rechnung"]
STREET_ENDS = ["strasse", "straße", "str.", "gasse", "gässli", "weg", "platz", "allee", "ring", "rain", "halde", "quai", "ufer", "steig", "graben", "matte", "matt", "hofstatt", "promenade", "damm", "zeile", "stieg", "pfad"]
STREET_FIRST = ["rue", "route", "avenue", "av.", "chemin", "ch.", "place", "boulevard", "bd", "impasse", "allée", "passage", "ruelle", "sentier", "quai", "promenade", "esplanade", "via", "viale", "piazza", "piazzale", "corso", "vicolo", "strada", "salita", "contrada", "largo"]
STREET_LAST = ["Road", "Street", "Lane", "Avenue", "Drive", "Close", "Way", "Square", "Court", "Crescent", "Terrace", "Place", "Hill", "Row"]
PREPOSITIONS = ["Am", "Im", "Zum", "Zur", "An der", "An den", "Auf der", "Auf dem", "In der", "In den", "Bei der", "Beim", "Unter der", "Hinter der", "Vor der", "Ob der", "Obere", "Untere", "Alte", "Neue", "Alter", "Neuer", "Grosse", "Kleine", "Lange", "Hintere", "Vordere", "Mittlere"]
COMPANY_WORDS = ["AG", "GmbH", "SA", "Sàrl", "Sagl", "KG", "Co", "Holding", "Stiftung", "Genossenschaft", "Treuhand", "Personal", "Gruppe", "Group", "Ltd", "Inc"]

_CAP = r"[A-ZÀ-ÖØ-Þ][\w’']*(?:-[A-ZÀ-ÖØ-Þa-z][\w’']*)*"
_ALTERNATIVES = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))

# A mailbox is found by its sign (@, (at), at, a character reference …), then read in both directions.
_AT = re.compile(
    r"\s?(?:@|＠|&#0*64;|&#[xX]40;|&commat;|%40|[(\[{](?:at|AT|ät|a|@)[)\]}])\s?|\s(?P<word>at|AT|ät|chiocciola|arobase)\s"
)
_AT_SIGNS = ("@", " at ", "(at", "[at", "{at", "&#", "＠", "&commat;", "%40", " AT ", "(a)", "[a]", "ät", "(AT", "[AT", " chiocciola ", " arobase ")
_LOCAL = re.compile(r"(?:^|(?<=[^\w.+%-]))[\w+%](?:[\w.+%-]*[\w+%-])?$")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\{dot\}|\[punkt\]|\(punkt\)|\[point\]|\(point\))\s?|\s(?:dot|DOT|punkt|point|punto)\s)[\w-]+)+")
_DOT_WORD = re.compile(r"\s(?:dot|DOT|punkt|point|punto)\s|[\[({](?:dot|punkt|point|\.)[\])}]")

_AHV = re.compile(r"(?<![\w.+-])756(?:[.\s-]?\d{4}){2}[.\s-]?\d{2}(?![\w-])")
_ID_CODE = re.compile(r"(?<![\w.+@/-])(?:[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|[A-Z]{1,2}\d{6,8}|[A-Z][A-Z0-9]{5,7}\d|\d{7,13})(?![\w@-])")
_ID_LABEL = re.compile(rf"(?:{_ALTERNATIVES(ID_LABELS)})[\w-]{{0,16}}\.?(?:\s?(?:Nr|No|Nummer|number|numéro|numero|n°))?\.?\s?:?\s$", re.I)
_PHONE = re.compile(
    r"(?<![\w.+/'’-])(?:"
    r"(?:\+|00)\s?41[\s./-]?(?:\(0\)\s?)?\d{2}[\s./'’-]?\d{3}[\s./'’-]?\d{2}[\s./'’-]?\d{2}"
    r"|\(0\d{2}\)\s?\d{3}[\s./'’-]?\d{2}[\s./'’-]?\d{2}"
    r"|0\d{2}[\s./'’-]?\d{3}[\s./'’-]?\d{2}[\s./'’-]?\d{2}"
    r"|(?:\+|00)\s?(?!41)[1-9]\d{0,2}[\s./-]?(?:\(0\)\s?)?(?:\d[\s./'’-]?){5,12}\d"
    r")(?![\w]|[-'’/]\d)"
)
# A capitalised word before a number; what stands before decides whether it is a street.
_HOUSE = re.compile(r"(?:[A-ZÀ-ÖØ-Þ][\w’'-]*\.?)\s(\d{1,4}(?:\s?[a-hA-H](?![\w’']))?)(?![\w%]|[.:'’]\d|\s?(?:Uhr|Prozent|%|km|Jahre|ans)\b)")
_STREET = re.compile(
    rf"(?<![\w’'-])(?:"
    rf"(?:(?:{_ALTERNATIVES(PREPOSITIONS)})\s)?[A-ZÀ-ÖØ-Þ][\w’'-]*(?:{_ALTERNATIVES(STREET_ENDS)})(?:\s(?:Nord|Süd|Ost|West))?"
    rf"|(?P<loose>(?:{_ALTERNATIVES(PREPOSITIONS)})\s{_CAP}(?:\s{_CAP})?)"
    rf"|(?i:{_ALTERNATIVES(STREET_FIRST)})\s(?:de\s(?:la\s|l[’'])?|du\s|des\s|d[’']|dei\s|del\s|della\s|delle\s|dello\s|degli\s|di\s|al\s|alla\s|la\s|le\s|les\s)?{_CAP}(?:\s{_CAP}){{0,2}}"
    rf"|{_CAP}(?:\s{_CAP}){{0,2}}\s(?:{_ALTERNATIVES(STREET_LAST)})"
    rf")\s$"
)
_STREET_HINT = re.compile(rf"(?:{_ALTERNATIVES(STREET_ENDS)})(?:\s(?:Nord|Süd|Ost|West))?\s$|(?:{_ALTERNATIVES(STREET_LAST)})\s$|\b(?:{_ALTERNATIVES(PREPOSITIONS)})\s|\b(?i:{_ALTERNATIVES(STREET_FIRST)})\s")
_DIGIT = re.compile(r"\d\d")
_CONTEXT_CUT = re.compile(r"[.!?>\n|]\s*|&nbsp;")

# Any longer number with its label; forms of address and mailboxes near it are its anchors.
_NUMBER = re.compile(r"(?<![\w.+])[+(]?[A-Z]{0,2}\d[\d./'’() -]{4,20}\d(?!\w)")
_ANCHOR = re.compile(rf"@|(?<!\w)(?:{_ALTERNATIVES([t for t in TITLES if len(t) > 2])})\s[A-ZÀ-Þ]")
_LABEL_CUT = re.compile(r"[.!?](?=\s)|[,;:>\n|()]|&nbsp;")
_NEAR = 110
LABEL = "#"
SURE_SHARE = 0.9

# Two or more adjacent capitalised words, titles, initials and particles.
_WORD = rf"(?:[A-ZÀ-ÖØ-Þ]\.(?:-[A-ZÀ-ÖØ-Þ]\.)?|(?:{_ALTERNATIVES([t for t in TITLES if t.endswith('.') or '.' in t])})|[A-ZÀ-ÖØ-Þ][\w’'-]*)"
_RUN = re.compile(rf"(?<![\w@.+/-])(?:{_WORD}|signora?|sig\.(?:ra)?|med\.)(?:\s(?:{_WORD}|med\.|(?:{_ALTERNATIVES(PARTICLES)})(?=\s[A-ZÀ-ÖØ-Þ])))+(?![@\w])")
_INITIAL = re.compile(r"[A-ZÀ-Þ]\.(?:-[A-ZÀ-Þ]\.)?")
_TITLE_SET = frozenset(TITLES)
_PARTICLE_SET = frozenset(PARTICLES)
_COMPANY_SET = frozenset(COMPANY_WORDS)


def emails(text: str) -> list[tuple[int, int]]:
    """Mailboxes, also spelled out or encoded."""
    out: list[tuple[int, int]] = []
    if not any(sign in text for sign in _AT_SIGNS):
        return out
    for m in _AT.finditer(text):
        local = _LOCAL.search(text[max(0, m.start() - 80):m.start()])
        domain = _DOMAIN.match(text, m.end()) if local else None
        if domain is None or (m["word"] and not _DOT_WORD.search(domain.group())):
            continue
        start = m.start() - (local.end() - local.start())
        if not out or start >= out[-1][1]:
            out.append((start, domain.end()))
    return out


def _before(text: str, at: int, width: int = 28) -> str:
    return text[max(0, at - width):at]


_BLOCKED = re.compile(rf"(?:{_ALTERNATIVES(NOT_A_PERSONS_NUMBER)})[\w.]*\s?:?\s?(?:Nr\.?\s?|No\.?\s?)?$", re.I)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _HOUSE.finditer(text):
        left = _before(text, m.start(1), 60)
        if not _STREET_HINT.search(left):
            continue
        s = _STREET.search(left)
        if s and not (s["loose"] and text[m.end():m.end() + 1] not in ("", ",", ".", ";", ")", "<", "\n")):
            yield m.start(1) - len(left) + s.start(), m.end(1)


def structured(text: str, cleared=frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything but names; no two overlap. Numbers with a `cleared` label are none."""
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _AHV.finditer(text):
            if not _BLOCKED.search(_before(text, m.start())):
                found.append(("id_number", *m.span()))
        for m in _ID_CODE.finditer(text):
            if _ID_LABEL.search(_before(text, m.start(), 48)):
                found.append(("id_number", *m.span()))
        for m in _PHONE.finditer(text):
            if not _BLOCKED.search(_before(text, m.start())):
                found.append(("phone", *m.span()))
        found += [("address", a, b) for a, b in _addresses(text)]
    if cleared and found:
        found = [f for f in found if f[0] == "email" or label_of(text, f[1]) not in cleared]
    if len(found) < 2:
        return found
    kept: list[tuple[str, int, int]] = []
    for f in sorted(found, key=lambda f: (KINDS.index(f[0]), f[1])):
        if all(f[2] <= a or f[1] >= b for _, a, b in kept):
            kept.append(f)
    return kept


def label_of(text: str, at: int) -> str:
    """The words that label what stands at a place: at most two, back to a sentence end, comma or tag."""
    left = text[max(0, at - 48) : at].rstrip(" :#.")
    return " ".join(w for w in _LABEL_CUT.split(left)[-1].lower().split()[-2:])


def labels(text: str) -> Iterator[tuple[str, bool]]:
    """(label, anchored) of every number of a text that has a label."""
    anchors = None
    for m in _NUMBER.finditer(text):
        label = label_of(text, m.start())
        if not label or not any(c.isalpha() for c in label):
            continue
        if anchors is None:
            anchors = [a.start() for a in _ANCHOR.finditer(text)]
        i = bisect_left(anchors, m.start() - _NEAR)
        yield label, i < len(anchors) and anchors[i] <= m.end() + _NEAR


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    word = word.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return "".join(c for c in unicodedata.normalize("NFD", word) if c.isalpha())


def context_of(text: str, at: int) -> str:
    """The words before a place, up to the last sentence end, at most three."""
    left = _CONTEXT_CUT.split(text[max(0, at - 60):at])[-1] if at else ""
    return " ".join(left.lower().split()[-3:])


def runs(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Words of each run, and where they start."""
    for m in _RUN.finditer(text):
        words = m.group().split()
        starts, at = [], m.start()
        for w in words:
            starts.append(at)
            at += len(w) + 1
        yield words, starts


def observations(text: str) -> Iterator[tuple[str, str, bool]]:
    """(context, term, anchored) of each pair of capitalised words of a text."""
    boxes = None
    for words, starts in runs(text):
        titled = False
        if not _PARTICLE_SET.isdisjoint(words):
            kept = [i for i, w in enumerate(words) if w not in _PARTICLE_SET]
            words, starts = [words[i] for i in kept], [starts[i] for i in kept]
        for i in range(len(words) - 1):
            first, second, at = words[i], words[i + 1], starts[i]
            if first in _TITLE_SET or (first == "M." and i == 0):
                titled = True
                continue
            if second in _COMPANY_SET or second in _TITLE_SET:
                titled = False
                continue
            if boxes is None:
                boxes = [_folded(text[a:b].split("@")[0]) for a, b in emails(text)]
            term = second if len(first) > 2 and first.isupper() and not second.isupper() else first
            in_box = any(len(f) > 3 and f in box for box in boxes for f in (_folded(first), _folded(second)))
            context = "" if titled else context_of(text, at)
            yield context, "x." if _INITIAL.fullmatch(term) else term, titled or in_box
            titled = False


def observed(df: DataFrame, text: str) -> DataFrame:
    """(context, term, n, n_anchored) over all texts of a column, summed; labels of numbers have the term LABEL."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        anchored: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(c, t, k, anchored[c, t]) for (c, t), k in n.items()], columns=["context", "term", "n", "n_anchored"])
            n.clear()
            anchored.clear()
            return out

        for pdf in batches:
            for t in pdf[text]:
                for context, term, sure in observations(t):
                    n[context, term] += 1
                    if sure:
                        anchored[context, term] += 1
                if _DIGIT.search(t):
                    for label, sure in labels(t):
                        n[label, LABEL] += 1
                        if sure:
                            anchored[label, LABEL] += 1
            if len(n) > 200_000:
                yield flush()
        yield flush()

    rows = df.select(text).where(F.length(text) > 0)
    counts = rows.mapInPandas(count, "context string, term string, n long, n_anchored long")
    return counts.groupBy("context", "term").agg(F.sum("n").alias("n"), F.sum("n_anchored").alias("n_anchored"))


def revealing(counts: DataFrame, *, min_bits: float = 2.0, min_share: float = 0.2, min_support: int = 3, min_context_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Terms (term, bits) and contexts (context, share) that reveal a person."""
    counts = counts.where(F.col("term") != LABEL)
    base = counts.agg((F.sum("n_anchored") / F.sum("n")).alias("base")).first()["base"] or 1.0  # one number
    per_term = counts.where(F.col("term") != "x.").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_anchored").alias("k"))
    bits = F.log2((F.col("k") / F.col("n")) / F.lit(float(base)))
    terms = per_term.where((F.col("k") >= min_support) & (F.col("k") / F.col("n") >= min_share)).select("term", bits.alias("bits"))
    terms = cut(terms.where(F.col("bits") >= min_bits))
    shares = (
        counts.where(F.col("context") != "")
        .join(terms.select("term", F.lit(1).alias("known")), "term", "left")
        .groupBy("context")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("k"))
    )
    share = F.col("k") / F.col("n")
    contexts = shares.where((F.col("k") >= min_support) & (share >= min_context_share)).select("context", share.alias("share"))
    return terms, cut(contexts)


def cleared_labels(counts: DataFrame, *, clear_bits: float = -0.45, min_support: int = 100) -> DataFrame:
    """(label, bits): labels whose numbers reveal no person, as their disclosure is surely below `clear_bits`."""
    own = counts.where(F.col("term") == LABEL)
    sums = own.agg(F.sum("n_anchored").alias("k"), F.sum("n").alias("n")).first()  # one row
    base = (sums["k"] or 1) / (sums["n"] or 1)
    upper = (F.col("n_anchored") + 2 * F.sqrt(F.col("n_anchored") + 1.0)) / F.col("n")
    return cut(own.where(F.col("n") >= min_support).select(F.col("context").alias("label"), F.log2(upper / F.lit(float(base))).alias("bits")).where(F.col("bits") < clear_bits))


def names(text: str, terms, contexts) -> list[tuple[int, int]]:
    """Places of persons' names, without titles, given the revealing terms and contexts."""
    out = []
    for words, starts in runs(text):
        if not any(w in _TITLE_SET or w in terms or w.isupper() or w[-1] == "." for w in words) and not _leads(contexts, text, starts[0], SURE_SHARE):
            continue
        i, titled = 0, False
        while i < len(words):
            word, at = words[i], starts[i]
            if word in _TITLE_SET or (word == "M." and i == 0 and not _leads(contexts, text, at)):
                titled = True
                i += 1
                continue
            if word in _PARTICLE_SET and i + 1 < len(words) and (titled or word.isupper() or _leads(contexts, text, at)):
                end = _name_end(words, i + 1, titled, text, at, terms, contexts)
            elif word in _PARTICLE_SET:
                end = None
            else:
                end = _name_end(words, i, titled, text, at, terms, contexts)
            titled = False
            if end is None:
                i += 1
                continue
            out.append((at, starts[end] + len(words[end])))
            i = end + 1
    return out


def _leads(contexts, text: str, at: int, share: float = 0.0) -> bool:
    return contexts.get(context_of(text, at), 0.0) > share


def _name_end(words: list[str], j: int, titled: bool, text: str, at: int, terms, contexts) -> int | None:
    """Index of the last word of a name that starts at place `at` with word `j` (after particles), or None."""
    word = words[j]
    k = j + 1
    while k < len(words) and (words[k] in _PARTICLE_SET or (_INITIAL.fullmatch(word) and _INITIAL.fullmatch(words[k]))):
        k += 1
    following = words[k] if k < len(words) else ""
    company = following in _COMPANY_SET
    surname = k if following and not company and following not in _TITLE_SET and not _INITIAL.fullmatch(following) else None
    if _INITIAL.fullmatch(word):
        return surname if titled or _leads(contexts, text, at) else None
    if word in terms:
        return surname if surname is not None else j if titled and not company else None
    if len(word) > 2 and word.isupper() and k == j + 1 and following in terms:
        return k
    # a first name that the corpus hardly knows, where almost only names stand
    if surname is not None and word not in _COMPANY_SET and _leads(contexts, text, at, SURE_SHARE):
        return surname
    if titled and not company and word not in _COMPANY_SET:
        return k if k == j + 1 and following in terms else j
    return None


def find(text: str, terms, contexts, cleared=frozenset()) -> list[tuple[str, int, int]]:
    """All findings of a text in order of place; none overlap."""
    kept = structured(text, cleared)
    for a, b in names(text, terms, contexts):
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append(("name", a, b))
    return sorted(kept, key=lambda f: f[1])


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b in found:
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join(out) + text[last:]


def own_lexicon(texts: DataFrame, terms: DataFrame, contexts: DataFrame, cleared: DataFrame) -> DataFrame:
    """texts(h, text) → (h, lexicon): the revealing terms and contexts and cleared labels of each text itself."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = set()
            for h, t in zip(pdf["h"], pdf["text"]):
                for words, starts in runs(t):
                    found.update((h, "t", w) for w in words)
                    found.update((h, "c", context_of(t, at)) for at in starts)
                found.update((h, "l", label_of(t, at)) for kind, at, _ in structured(t) if kind != "email")
            yield pd.DataFrame(list(found), columns=["h", "kind", "value"])

    occurring = texts.mapInPandas(emit, "h long, kind string, value string")
    known = terms.select(F.lit("t").alias("kind"), F.col("term").alias("value"), F.col("bits").alias("score")).unionByName(
        contexts.select(F.lit("c").alias("kind"), F.col("context").alias("value"), F.col("share").alias("score"))
    ).unionByName(cleared.select(F.lit("l").alias("kind"), F.col("label").alias("value"), F.col("bits").alias("score")))
    return occurring.join(known, ["kind", "value"]).groupBy("h").agg(F.collect_list(F.struct("kind", "value", "score")).alias("lexicon"))


def sanitised(df: DataFrame, *, key: list[str], text: str, min_bits: float = 2.0, min_support: int = 3, clear_bits: float = -0.45, min_label_support: int = 100, max_terms: int = 500_000) -> DataFrame:
    """`key` columns, `clean_text` with placeholders and `findings` array<struct<kind, found_text, start, end>>.

    `max_terms` bounds the lexicon that is sent to every worker (about 20 MB); a larger one is joined
    to the terms of each text.
    """
    source = df.select(*key, F.col(text).alias("__text"))
    counts = cut(observed(source, "__text"))
    terms, contexts = revealing(counts, min_bits=min_bits, min_support=min_support)
    cleared = cleared_labels(counts, clear_bits=clear_bits, min_support=min_label_support)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema += ", clean_text string, findings array<struct<kind:string,found_text:string,start:int,end:int>>"
    if at_most(terms, max_terms) and at_most(contexts, max_terms) and at_most(cleared, max_terms):
        collected = ({r["term"]: r["bits"] for r in terms.collect()}, {r["context"]: r["share"] for r in contexts.collect()}, frozenset(r["label"] for r in cleared.collect()))
        lexicon = df.sparkSession.sparkContext.broadcast(collected)
    else:
        lexicon = None
        hashed = source.withColumn("__h", F.xxhash64("__text"))
        texts = hashed.where(F.length("__text") > 0).select(F.col("__h").alias("h"), F.col("__text").alias("text")).dropDuplicates(["h"])
        own = own_lexicon(texts, terms, contexts, cleared).select(F.col("h").alias("__h"), F.col("lexicon").alias("__own"))
        source = hashed.join(own, "__h", "left").drop("__h")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, leads, free = lexicon.value if lexicon else ({}, {}, frozenset())
        for pdf in batches:
            texts, lists = [], []
            for i, t in enumerate(pdf["__text"]):
                if lexicon is None and t:
                    own = pdf["__own"].iloc[i]
                    entries = own if own is not None and not isinstance(own, float) else []
                    known = {e["value"]: e["score"] for e in entries if e["kind"] == "t"}
                    leads = {e["value"]: e["score"] for e in entries if e["kind"] == "c"}
                    free = frozenset(e["value"] for e in entries if e["kind"] == "l")
                found = find(t, known, leads, free) if t else []
                texts.append(redact(t, found) if found else t)
                lists.append([{"kind": k, "found_text": t[a:b], "start": a, "end": b} for k, a, b in found])
            out = pdf[key].copy()
            out["clean_text"] = texts
            out["findings"] = lists
            yield out

    return source.mapInPandas(scan, schema)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = texts(spark, sf_dir, "jobs", "id", "description_md")
    raw = texts(spark, sf_dir, "ch_media_vacancies", "id", "requirements")
    return jobs.select(F.lit("jobs").alias("src"), F.col("id").alias("row_id"), F.col("description_md").alias("text")).unionByName(
        raw.select(F.lit("ch_media_vacancies").alias("src"), F.col("id").alias("row_id"), F.col("requirements").alias("text"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of jobs.description_md and ch_media_vacancies.requirements as they stand there."""
    done = sanitised(_fields(spark, sf_dir), key=["src", "row_id"], text="text")
    return done.select("src", "row_id", F.explode("findings").alias("f")).select("src", "row_id", "f.kind", "f.found_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    done = sanitised(_fields(spark, sf_dir), key=["src", "row_id"], text="text")
    return done.select("src", "row_id", "clean_text", F.size("findings").alias("n_findings"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE_SQL: dict[str, str] = {}
