"""Markup residue in texts: which notations are there, and clean text that keeps the structure.

A text passes a lexer that takes notations off one after the other and notes each family met: code
is set aside first (its content is no markup, its delimiters are), then formulas, HTML, wiki, LaTeX
and Markdown. Left is flat text in which private-use characters mark headings, list items, quotes,
links, code and formulas. This is cut into flat blocks; every block not yet marked is classified by
a decision tree on its word count, link density, and those of its neighbours (trained on the
small set of labelled texts below), as text, heading, list item, boilerplate or code. Code found so is
set aside and the text lexed again without it, so the families of a text are those of its other blocks.

Edge cases: null gives null text, no families and no blocks; empty and blank texts give "" and
nothing else; unbalanced delimiters (an unclosed tag, fence or brace) are ordinary text; repeated
rows are treated one by one; words outside of markup are never lost (a wiki template leaves its arguments, a
sign of per cent is no LaTeX comment); very long texts are processed whole, every pattern is linear in
practice as none nests unbounded repeats. An escape counts for LaTeX where the text has LaTeX
structure and for Markdown elsewhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import texts

FAMILIES = ("html", "markdown", "wiki", "latex")
HEADING, ITEM, QUOTE, LINK, LINK_END, HOLD, HOLD_END, ROW = "\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008"
_PRIVATE = re.compile("[\ue000-\ue008]")

_CODE = re.compile(
    r"(?P<fence>(?:^|\n)[ ]{0,3}(?P<f>```|~~~)[^\n`]*\n(?P<fc>.*?)(?:\n[ ]{0,3}(?P=f)`*~*[ ]*(?=\n|$)|\Z))"
    r"|(?P<pre><(?P<p>pre|code|tt|samp|kbd)\b[^<>]*>(?P<pc>.*?)</(?P=p)\s*>)"
    r"|(?P<wiki><(?P<w>nowiki|syntaxhighlight|source)\b[^<>]*>(?P<wc>.*?)</(?P=w)\s*>)"
    r"|(?P<verb>\\begin\{(?P<v>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?P<vc>.*?)\\end\{(?P=v)\})"
    r"|(?P<short>\\verb\*?(?P<d>[|!+/])(?P<dc>[^\n]*?)(?P=d))"
    r"|(?P<tick>(?<![`\\])(?P<t>`{1,2})(?!`)(?P<tc>[^\n]+?)(?<!`)(?P=t)(?!`))",
    re.S | re.I,
)
_MATH_ENV = "equation|align|gather|multline|displaymath|math|eqnarray"
_FORMULA = re.compile(
    r"\$\$(?P<a>[^$]+?)\$\$"
    r"|\\\[(?P<b>(?:(?!\\\]).)*?[\\^_={}](?:(?!\\\]).)*?)\\\]"
    r"|\\\((?P<c>(?:(?!\\\)).)*?[\\^_={}+](?:(?!\\\)).)*?)\\\)"
    rf"|\\begin\{{(?P<e>(?:{_MATH_ENV})\*?)\}}(?P<f>.*?)\\end\{{(?P=e)\}}"
    r"|(?<![\\$\w])\$(?P<d>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])",
    re.S,
)
_MATHLIKE = re.compile(r"[\\^_{}=]|^[A-Za-z]$")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_STYLE = re.compile(r"<(style|script)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# HTML elements by what they do to the flow of text; wiki-only elements.
_BREAKING = frozenset("address article aside blockquote body br caption center dd div dl dt fieldset figure footer form header hr html main nav ol p section table tbody td tfoot th thead tr ul".split())
_WIKI_TAGS = frozenset("ref references nowiki gallery".split())

_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_QUOTES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)([^\n]*?\S)\1(?!')")
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-+[ \t]*$", re.M)
_WIKI_EXTERNAL = re.compile(r"(?<!\])\[https?://[^\s\]]+ ([^\]\n]+)\](?!\()")
_WIKI_SWITCH = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION)__")
_WIKI_BULLET = re.compile(r"^[*#:;]+[ \t]*", re.M)
_WIKI_NESTED = re.compile(r"^(?:\*{2,}|#{2,}|:+)[ \t]+(?=\S)", re.M)

_COMMAND = re.compile(r"(?<![\w\\:])\\([A-Za-z]+)\*?(?![A-Za-z])")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}")
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?")
_TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_TEX_LINK = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_TEX_URL = re.compile(r"\\url\{([^{}\n]*)\}")
_TEX_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_TEX_OTHER = re.compile(r"\\[A-Za-z]+\*?[ \t]?")
_TEX_ESCAPE = re.compile(r"\\([#$%&_{}])")
_TEX_COMMENT = re.compile(r"(?m)^[ \t]*%[^\n]*\n?")
_TEX_COMMENT_IN_DOCUMENT = re.compile(r"(?m)(?<![\\\d])(?<!\d[ \u00a0\u202f])%[^\n]*$")
_TEX_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?")

_MD_HEAD = re.compile(r"^[ ]{0,3}#{1,6}[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_SETEXT = re.compile(r"^([^\s\n|>][^\n]*)\n[ ]{0,3}(?:-{3,}|={3,})[ \t]*$", re.M)
_MD_RULE = re.compile(r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$", re.M)
_MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|[ \t]*(?::?-{3,}:?[ \t]*)?$", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|([^\n]*)\|[ \t]*$", re.M)
_MD_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(?=\S)", re.M)
_MD_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ \t]+\"[^\"\n]*\")?\)")
_MD_LINK = re.compile(r"\[([^\[\]\n]+)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ \t]+\"[^\"\n]*\")?\)")
_MD_REFERENCE = re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_MD_REFLINK = re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_MD_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_MD_STRIKE = re.compile(r"~~(?=\S)([^\n~]*?\S)~~")
_MD_STRONG = re.compile(r"(?<![\w\\*_])(\*\*\*|\*\*|___|__)(?=[^\s*_])([^\n]*?[^\s\\])\1(?![\w])")
_MD_STRONG_INNER = re.compile(r"(\*\*)(?=[^\s*])([^\n*]*?[^\s\\*])\1")
_MD_EMPHASIS = re.compile(r"(?<![\w\\*_])([*_])(?=[^\s*_])([^\n*_]*?[^\s\\*_])\1(?![\w*_])")
_MD_TASK = re.compile(r"^([ \t]*[-*+])[ \t]+\[[ xX]\][ \t]+", re.M)
_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")

_BULLET = re.compile(r"^[ \t]*(?:[-*+•·–—→▪●◦‣■□✓✔]|\d{1,2}[.)])[ \t]+(?=\S)")
_SPACES = re.compile(r"[^\S\n]+")


@dataclass
class Lexed:
    """Flat text with private marks, the families met, and what was set aside."""

    text: str
    families: set[str] = field(default_factory=set)
    held: list[tuple[str, str]] = field(default_factory=list)


def lex(text: str, aside: Callable[[str], bool] | None = None) -> Lexed:
    """Takes all notations off a text; lines that `aside` picks are held as code."""
    out = Lexed(_PRIVATE.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    seen = out.families

    def hold(kind: str, content: str) -> str:
        out.held.append((kind, content))
        return f"{HOLD}{len(out.held) - 1}{HOLD_END}"

    def code(m: re.Match) -> str:
        if m["fence"] is not None:
            seen.add("markdown")
            return "\n" + hold("code", m["fc"])
        if m["pre"] is not None:
            seen.add("html")
            inner = _TAG.sub("", m["pc"])
            block = m["p"].lower() == "pre"
            kept = hold("code" if block else "inline_code", html.unescape(inner).strip("\n"))
            return f"\n{kept}\n" if block else kept
        if m["wiki"] is not None:
            seen.add("wiki")
            return hold("code" if m["w"].lower() != "nowiki" else "inline_code", m["wc"].strip("\n"))
        if m["verb"] is not None:
            seen.add("latex")
            return "\n" + hold("code", m["vc"].strip("\n")) + "\n"
        if m["short"] is not None:
            seen.add("latex")
            return hold("inline_code", m["dc"])
        seen.add("markdown")
        return hold("inline_code", m["tc"].strip())

    t = out.text
    if aside is not None:
        t = "\n".join(hold("code", line.strip()) if line.strip() and aside(line) else line for line in t.split("\n"))
    if "`" in t or "~~~" in t or "<" in t or "\\" in t:
        t = _CODE.sub(code, t)

    def formula(m: re.Match) -> str:
        inner = next(g for g in (m["a"], m["b"], m["c"], m["f"], m["d"]) if g is not None)
        if not _MATHLIKE.search(inner):
            return m.group()
        seen.add("latex")
        display = m["c"] is None and m["d"] is None
        kept = hold("formula" if display else "inline_formula", inner.strip())
        return f"\n{kept}\n" if display else kept

    if "$" in t or "\\" in t:
        t = _FORMULA.sub(formula, t)
    if "<" in t:
        t = _take_html_tags(t, seen)
    if "&" in t:
        t = _ENTITY.sub(lambda m: _reference(m, seen), t)
    t = t.replace("\u00a0", " ")
    t = _take_wiki(t, seen)
    tex = False
    if "\\" in t:
        t, tex = _take_latex(t, seen)
    t = _take_markdown(t, seen, tex)
    out.text = t
    return out


def _reference(m: re.Match, seen: set[str]) -> str:
    ref = m.group()
    if ref[1] != "#" and ref[1:] not in html5:
        return ref
    seen.add("html")
    return html.unescape(ref)


def _take_html_tags(t: str, seen: set[str]) -> str:
    t, n = _COMMENT.subn("", t)
    t, k = _STYLE.subn(" ", t)
    if n or k:
        seen.add("html")

    def tag(m: re.Match) -> str:
        name = (m[1] or "").lower()
        if name in _WIKI_TAGS:
            seen.add("wiki")
            return " "
        seen.add("html")
        closing = m.group()[1] == "/"
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            return "\n" if closing else "\n" + HEADING
        if name == "li":
            return "\n" if closing else "\n" + ITEM
        if name == "a":
            return LINK_END if closing else LINK
        if name in ("sup", "sub") and not closing:
            return "^" if name == "sup" else "_"
        return "\n" if name in _BREAKING else ""

    return _TAG.sub(tag, t)


def _take_wiki(t: str, seen: set[str]) -> str:
    found = 0

    def take(pattern: re.Pattern, by, s: str) -> str:
        nonlocal found
        s, n = pattern.subn(by, s)
        found += n
        return s

    if "==" in t:
        t = take(_WIKI_HEAD, lambda m: f"\n{HEADING}{m[2]}\n", t)
    heads = found
    if "[[" in t:
        t = take(_WIKI_LINK, lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    while "{{" in t:  # templates within templates, from the inside
        before = found
        t = take(_WIKI_TEMPLATE, lambda m: _arguments(m.group()), t)
        if found == before:
            break
    if "''" in t:
        t = take(_WIKI_QUOTES, lambda m: m[2], t)
    if "{|" in t or "|}" in t:
        t = take(_WIKI_TABLE, "", t)
    if "[http" in t:
        t = take(_WIKI_EXTERNAL, lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    if "TOC__" in t or "SECTION__" in t:
        t = take(_WIKI_SWITCH, "", t)
    if found:
        seen.add("wiki")
        t = (_WIKI_BULLET if heads else _WIKI_NESTED).sub(ITEM, t)
    return t


def _arguments(template: str) -> str:
    """The values of a template's arguments; those of one without arguments are none."""
    values = (part.partition("=")[2] if "=" in part else part for part in template[2:-2].split("|")[1:])
    return " ".join(v for v in map(str.strip, values) if v)


def _take_latex(t: str, seen: set[str]) -> tuple[str, bool]:
    if not _COMMAND.search(t):
        return t, False
    seen.add("latex")
    # a sign of per cent is no comment: only at the start of a line, or in a whole document after no number
    t = _TEX_COMMENT.sub("", t)
    if "\\documentclass" in t or "\\begin{document}" in t:
        t = _TEX_COMMENT_IN_DOCUMENT.sub("", t)
    t = _TEX_HEAD.sub(lambda m: f"\n{HEADING}{m[1]}\n", t)
    t = _TEX_ENV.sub("\n", t)
    t = _TEX_ITEM.sub("\n" + ITEM, t)
    t = _TEX_LINK.sub(lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    t = _TEX_URL.sub(lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    # a line that is one bold argument and a line break is a heading
    t = re.sub(r"(?m)^[ \t]*\\textbf\{([^{}\n]*)\}[ \t]*(?:\\\\)?[ \t]*$", lambda m: f"{HEADING}{m[1]}", t)
    n = 1
    while n:  # arguments within arguments, from the inside; every round takes off a command
        t, n = _TEX_ARGUMENT.subn(lambda m: m[1], t)
    t = _TEX_BREAK.sub("\n", t)
    t = _TEX_ESCAPE.sub(lambda m: m[1], t)
    t = _TEX_OTHER.sub("", t)
    return t.replace("~", " ") if "~~" not in t else t, True


def _take_markdown(t: str, seen: set[str], tex: bool) -> str:
    found = 0

    def take(pattern: re.Pattern, by, s: str) -> str:
        nonlocal found
        s, n = pattern.subn(by, s)
        found += n
        return s

    if "#" in t:
        t = take(_MD_HEAD, lambda m: f"{HEADING}{m[1]}", t)
    if "---" in t or "===" in t:
        if "|" in t:
            t = take(_MD_TABLE, "", t)
        t = take(_MD_SETEXT, lambda m: f"{HEADING}{m[1]}", t)
    if "---" in t or "***" in t or "___" in t or "- - -" in t or "* * *" in t:
        t = take(_MD_RULE, "", t)
    if "|" in t and found:
        t = _MD_ROW.sub(lambda m: ROW + " ; ".join(c.strip() for c in m[1].split("|") if c.strip()), t)
    if ">" in t:
        t = take(_MD_QUOTE, QUOTE, t)
    if "[" in t:
        t = take(_MD_TASK, lambda m: m[1] + " ", t)
        if "](" in t:
            t = take(_MD_IMAGE, lambda m: m[1], t)
            t = take(_MD_LINK, lambda m: f"{LINK}{m[1]}{LINK_END}", t)
        if "]: " in t:
            t = take(_MD_REFERENCE, "", t)
        if "][" in t:
            t = take(_MD_REFLINK, lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    if "<" in t:
        t = take(_MD_AUTOLINK, lambda m: f"{LINK}{m[1]}{LINK_END}", t)
    if "~~" in t:
        t = take(_MD_STRIKE, lambda m: m[1], t)
    if "**" in t or "__" in t:
        t = take(_MD_STRONG, lambda m: m[2], t)
        t = take(_MD_STRONG_INNER, lambda m: m[2], t)
    if "*" in t or "_" in t:
        t = take(_MD_EMPHASIS, lambda m: m[2], t)
    if "\\" in t and not tex:
        t = take(_MD_ESCAPE, lambda m: m[1], t)
    if found:
        seen.add("markdown")
    return t


# --- blocks and their classification -----------------------------------------------------------

# A small labelled set of texts: one line per block, its label before it (see LABELS).
LABELLED_TEXTS = (
    """
B [Startseite](/) [Stellen](/s) [Kontakt](/k)
H Wer wir sind
T Das Spital am See behandelt seit vielen Jahren Menschen aus der ganzen Region und bildet Fachleute aus.
H Ihre Aufgaben:
L Sie planen die Einsätze der Abteilung
L Sie schreiben Berichte für die Leitung
L Pflege der Daten im System
H Ihr Profil
L Abgeschlossene Ausbildung in der Pflege
L Gute Kenntnisse in Deutsch und Englisch
L 3 Jahre Erfahrung auf einer Station
T Wir freuen uns auf Ihre Bewerbung bis Ende Monat.
B [Impressum](/i) | [Datenschutz](/d)
""",
    """
H Notre offre
T Nous vous proposons une place dans une équipe motivée, des horaires souples et un salaire juste.
T Le poste est à pourvoir de suite ou à convenir.
H Votre mission :
L Conseiller les clients au guichet
L Rédiger les offres et suivre les commandes
L tenir à jour le catalogue
H Contact
T Pour toute question, notre service du personnel vous répond volontiers le matin.
B [Plus d'annonces](/a)
B [Toutes les régions](/r)
""",
    """
H About the role
T You join a small team that looks after the machines of three plants, and you report to the head of maintenance.
L Plan inspections and order spare parts
L Keep the records up to date
L train new colleagues
H What we offer:
L Five weeks of holiday
L A free parking space
T Please send your documents as one file. We answer within a week.
B [Jobs](/j) [Companies](/c) [Salaries](/l) [Login](/in)
""",
    """
T Der folgende Ausschnitt zeigt, wie die Liste eingelesen wird.
C int total = 0;
C for (i = 0; i < rows.length; i++) {
C total += rows[i].size();
C }
T Danach steht die Summe bereit, und der Bericht kann gedruckt werden.
C def load(path, mode="r"):
C return open(path, mode).read()
H Hinweise
T Die Funktion liest ganze Dateien, deshalb sollte man sie nicht für grosse Mengen verwenden.
""",
    """
H Compiti
L Gestire la cassa e il magazzino
L Accogliere gli ospiti alla reception
L Preparare le camere secondo il piano
H Requisiti:
L Diploma di commercio o formazione simile
L Buone conoscenze di tedesco
T Offriamo un contratto a tempo indeterminato e una mensa aperta anche la sera.
T Inizio: subito o da convenire.
B [Altri annunci](/x) [Torna su](#top)
""",
    """
H Lohn und Vertrag
T Der Lohn richtet sich nach den Empfehlungen des Verbandes. Er wird dreizehnmal bezahlt.
T Ein Pensum von 80 Prozent ist möglich, wenn die Schichten im Team verteilt werden können.
T Mehr dazu steht im [Merkblatt](/m) der Stadt.
H Ablauf
L Gespräch mit der Leitung
L Schnuppertag im Betrieb
L Entscheid innert zwei Wochen
B [A](/a) [B](/b) [C](/c)
B [Weitere Stellen in Bern](/bern)
""",
    """
T Die Abfrage liefert die offenen Stellen je Ort.
C SELECT city, count(*) AS n FROM jobs WHERE status = 'open' GROUP BY city;
T Sie läuft jede Nacht.
C if (n > 10) { send(mail, n); }
C x = a[0] * b[1] + c[2];
T Wer das Skript ändert, meldet es der Leitung.
H Wie die Quote berechnet wird
T E_h = Ertrag/Stunden ≥ 0.85
T ∑ w_i s_i
T Ergebnis = 2 x + y
""",
    """
T Mit rund 20 Mitarbeitenden gestaltet die Werkstatt den Alltag in der Region und sucht Verstärkung.
H Das bringen Sie mit:
L - Berufserfahrung in der Küche
L - Freude am Umgang mit Gästen
H Darauf dürfen Sie sich freuen
L - Fünf Wochen Ferien
L - Ein Zimmer im Haus, 80 %, [auf Wunsch]
H Haben wir Ihr Interesse geweckt?
T Senden Sie Ihre Unterlagen an die Leitung der Küche, wir melden uns bald.
T Sie finden uns an der Adresse Musterweg 1, gleich beim Bahnhof. Das Gespräch findet in zwei Wochen statt. Koch
T Ansprechperson: Anna Muster / anna@muster.example
T x^2 + y_n = k
T E-Mail: anna.muster+jobs (at) muster.example
""",
    """
H Ce que vous apportez
L - Un diplôme de commerce
L - Au moins deux ans de pratique
H Nous vous offrons les avantages suivants :
L - Une place de parc
L - Des horaires souples
T Le poste est à pourvoir de suite ou à convenir, et nous vous attendons avec plaisir.
T Questions : A. Exemple, tél. +41 00 000 00 00
H Intéressé ?
T Nous nous réjouissons de recevoir votre dossier complet.
H Your next steps with us
L - An interview on site
L - A trial day
H How to reach our office
T The office is open in the morning, and the team answers calls until noon.
""",
)
LABELS = {"T": "text", "H": "heading", "L": "item", "B": "boilerplate", "C": "code"}
LABEL_NAMES = tuple(LABELS.values())
_CODE_SIGN = re.compile(r"[{};=<>|]|(?<=\w)[(\[]")


def block_features(parts: list[tuple[str, int, float, float]], listed: list[bool], i: int) -> tuple:
    """Features of block `i` of parts as `_flat` gives them: its own, and words, links and list marks around it."""
    line, n, links, signs = parts[i]
    before = parts[i - 1] if i else ("", 0, 0.0, 0.0)
    after = parts[i + 1] if i + 1 < len(parts) else ("", 0, 0.0, 0.0)
    return (n, links, line[-1] in ".!…", line[-1] == ":", line[0].islower() or line[0].isdigit(), signs, line[-1] in ";{}", before[1], before[2], after[1], after[2], i > 0 and listed[i - 1], i + 1 < len(parts) and listed[i + 1])


def labelled_blocks(texts_: tuple[str, ...]) -> tuple[list[tuple], list[int]]:
    """Features and labels of the blocks of labelled texts, but for items with a mark of their own."""
    rows, labels = [], []
    for text in texts_:
        lines = [line for line in text.split("\n") if line]
        listed = [bool(_BULLET.match(line[2:])) for line in lines]
        plain = [_BULLET.sub("", line[2:], count=1) for line in lines]
        parts = [_flat(lex(x), lex(x).text if line[0] != "C" else x) for line, x in zip(lines, plain)]
        rows += [block_features(parts, listed, i) for i in range(len(parts)) if not listed[i]]
        labels += [list(LABELS).index(line[0]) for i, line in enumerate(lines) if not listed[i]]
    return rows, labels


_HELD = re.compile(rf"{HOLD}(\d+){HOLD_END}")


def _flat(lexed: Lexed, line: str) -> tuple[str, int, float, float]:
    """(text, words, link density, share of code signs outside formulas and code) of one line of lexed text."""
    linked = sum(len(s.split(LINK_END)[0].split()) for s in line.split(LINK)[1:])
    line = line.replace(LINK, "").replace(LINK_END, "")
    if HOLD in line:
        own = _HELD.sub("", line)
        line = _HELD.sub(lambda m: _inline(lexed.held[int(m[1])]), line)
    else:
        own = line
    line = _SPACES.sub(" ", line).strip()
    n = len(line.split())
    return line, n, linked / n if n else 0.0, len(_CODE_SIGN.findall(own)) / max(1, len(own))


class DecisionTree:
    """Binary splits by Gini impurity on a small table; prediction is vectorised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        counts = np.bincount(y)
        if depth == 0 or counts.max() == len(y):
            return int(counts.argmax())
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                impurity = sum(part.sum() * (1 - ((np.bincount(y[part]) / part.sum()) ** 2).sum()) for part in (left, ~left))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut, left)
        if best is None:
            return int(counts.argmax())
        _, f, cut, left = best
        return f, float(cut), self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict_one(self, row) -> int:
        node = self.root
        while not isinstance(node, int):
            f, cut, low, high = node
            node = low if row[f] <= cut else high
        return node


@cache
def block_tree() -> DecisionTree:
    rows, labels = labelled_blocks(LABELLED_TEXTS)
    return DecisionTree(np.array(rows, dtype=float), np.array(labels))


def blocks(lexed: Lexed) -> list[tuple[str, str]]:
    """(kind, text) of the flat blocks; boilerplate is among them, marked as such."""
    kinds: list[str | None] = []
    flat: list[tuple[str, int, float, float]] = []
    for line in lexed.text.split("\n"):
        kind = None
        for mark, name in ((HEADING, "heading"), (ITEM, "item"), (QUOTE, "quote"), (ROW, "row")):
            if mark in line:
                kind = kind or name
                line = line.replace(mark, "")
        if _BULLET.match(line):
            kind = kind or "item"
            line = _BULLET.sub("", line, count=1)
        alone = re.fullmatch(rf"\s*{HOLD}(\d+){HOLD_END}\s*", line) if HOLD in line else None
        if alone:
            what, content = lexed.held[int(alone[1])]
            kinds.append(what.removeprefix("inline_"))
            flat.append((content, len(content.split()), 0.0, 0.0))
            continue
        made = _flat(lexed, line)
        if made[0]:
            kinds.append(kind)
            flat.append(made)
    listed = [k == "item" for k in kinds]
    tree = block_tree()
    named = [kind or LABEL_NAMES[tree.predict_one(block_features(flat, listed, i))] for i, kind in enumerate(kinds)]
    out = []
    for i, (kind, (line, *_)) in enumerate(zip(named, flat)):
        if kinds[i] is None and kind == "item" and not any(k == "item" for k in (*named[max(0, i - 1) : i], *named[i + 1 : i + 2])):
            kind = "text"  # a list has more than one entry
        elif kinds[i] is None and kind == "code":
            kind = "loose_code"
        out.append((kind, line))
    return out


def _inline(held: tuple[str, str]) -> str:
    kind, content = held
    return f"${content}$" if "formula" in kind else content


def render(parts: list[tuple[str, str]]) -> str:
    """Plain text: headings on their own lines, list items dashed, code indented, formulas in $."""
    lines: list[str] = []
    last = None
    for kind, text in parts:
        if kind == "boilerplate":
            continue
        if last is not None and not (kind == last and kind in ("item", "row", "quote")):
            lines.append("")
        if kind == "item":
            lines.append(f"- {text}")
        elif kind == "code":
            lines.extend("    " + s for s in text.split("\n"))
        elif kind == "formula":
            lines.append(f"${text}$")
        else:
            lines.append(text)
        last = kind
    return "\n".join(lines)


def convert(text: str) -> tuple[list[str], str, list[tuple[str, str]]]:
    """(families, clean text, blocks) of one text.

    Blocks that the tree takes for code without delimiters are set aside like delimited code, and the rest is
    lexed again: what looks like markup in them counts for no family and is not taken off.
    """
    lexed = lex(text)
    parts = blocks(lexed)
    if any(kind == "loose_code" for kind, _ in parts):
        if lexed.families:
            loose = {line for kind, line in parts if kind == "loose_code"}
            lexed = lex(text, aside=lambda line: not _TAG.search(line) and _flat(own := lex(line), own.text)[0] in loose)
            parts = blocks(lexed)
        parts = [("code" if kind == "loose_code" else kind, line) for kind, line in parts]
    return [f for f in FAMILIES if f in lexed.families], render(parts), parts


def plain_words(text: str) -> str:
    """The text without markup, code and link targets, for comparisons of wording."""
    lexed = lex(text)
    t = re.sub(f"[{HEADING}{ITEM}{QUOTE}{ROW}]", " ", lexed.text).replace(LINK, "").replace(LINK_END, "")
    return re.sub(rf"{HOLD}(\d+){HOLD_END}", lambda m: "" if lexed.held[int(m[1])][0] == "code" else f" {lexed.held[int(m[1])][1]} ", t)


def markup_families(df: DataFrame, *, key: list[str], text: str) -> DataFrame:
    """`key` columns and `family`: one row for each family of markup in the blocks of `text` that aren't code."""
    keys = df.select(*key, F.col(text).alias("__text")).where(F.length("__text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields[:-1]) + ", family string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [convert(t)[0] for t in pdf["__text"]]
            rows = np.repeat(np.arange(len(pdf)), [len(f) for f in found])
            out = pdf[key].iloc[rows].copy()
            out["family"] = [f for fs in found for f in fs]
            yield out

    return keys.mapInPandas(scan, schema)


def clean_texts(df: DataFrame, *, key: list[str], text: str) -> DataFrame:
    """`key` columns with `families`, `clean_text` and `blocks` of every row."""
    keys = df.select(*key, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields[:-1])
    schema += ", families array<string>, clean_text string, blocks array<struct<kind:string,text:string>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [([], None, []) if t is None else convert(t) for t in pdf["__text"]]
            out = pdf[key].copy()
            out["families"] = [d[0] for d in done]
            out["clean_text"] = [d[1] for d in done]
            out["blocks"] = [[{"kind": k, "text": s} for k, s in d[2]] for d in done]
            yield out

    return keys.mapInPandas(scan, schema)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = texts(spark, sf_dir, "jobs", "id", "description_md")
    raw = texts(spark, sf_dir, "ch_media_vacancies", "id", "activity")
    return jobs.select(F.lit("jobs").alias("src"), F.col("id").alias("row_id"), F.col("description_md").alias("text")).unionByName(
        raw.select(F.lit("ch_media_vacancies").alias("src"), F.col("id").alias("row_id"), F.col("activity").alias("text"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of markup in jobs.description_md and ch_media_vacancies.activity."""
    return markup_families(_fields(spark, sf_dir), key=["src", "row_id"], text="text").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text and blocks of both fields."""
    return clean_texts(_fields(spark, sf_dir), key=["src", "row_id"], text="text")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
ORACLE_SQL: dict[str, str] = {}
