"""Contact data in fields and free text: redaction, safe URLs, JSON walks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import fixed_values as V
from gleaner.functions.text import rx


def redact_text(c: Column) -> Column:
    """Mailboxes, then phone numbers, become placeholders; null stays null."""
    no_mail = F.regexp_replace(c, rx(V.EMAIL), V.EMAIL_PLACEHOLDER)
    return F.regexp_replace(no_mail, rx(V.PHONE), V.PHONE_PLACEHOLDER)


def has_contact_data(c: Column) -> Column:
    return F.coalesce(c.rlike(rx(V.EMAIL)) | c.rlike(rx(V.PHONE)), F.lit(False))


def safe_form_url(url: Column) -> Column:
    """Trimmed http(s) URL with a host, without user names and mailboxes; null otherwise."""
    u = F.trim(url)
    host = F.try_parse_url(u, F.lit("AUTHORITY"))
    ok = u.rlike(r"^(?i)https?://") & (F.coalesce(host, F.lit("")) != "") & ~F.contains(host, F.lit("@")) & ~u.rlike(rx(V.EMAIL))
    return F.when(ok, u)


_EMAIL = re.compile(V.EMAIL)
_PHONE = re.compile(V.PHONE)
_KEYS = frozenset(V.CONTACT_KEYS) | frozenset(V.CONTACT_BLOCKS)
_SUFFIXES = tuple(V.CONTACT_KEY_SUFFIXES)


def _is_contact(key: str) -> bool:
    return key in _KEYS or key.lower().endswith(_SUFFIXES)


def _redact(text: str, phones: bool = True) -> str:
    text = _EMAIL.sub(V.EMAIL_PLACEHOLDER, text)
    return _PHONE.sub(V.PHONE_PLACEHOLDER, text) if phones else text


def _scrub(node, key: str = ""):
    """Without contact keys, strings redacted; URLs stay, and in fields of numbers and paths so do digits."""
    if isinstance(node, dict):
        return {k: _scrub(v, k) for k, v in node.items() if not _is_contact(k)}
    if isinstance(node, list):
        return [_scrub(v, key) for v in node]
    if isinstance(node, str) and not node.startswith(("http://", "https://", "//")):
        return _redact(node, not any(hint in key.lower() for hint in V.NUMBER_KEY_HINTS))
    return node


def _safe_url(value) -> str | None:
    """The JSON counterpart of `safe_form_url`."""
    if not isinstance(value, str):
        return None
    m = re.match(r"(?i)https?://([^/?#\s]+)[^\s]*$", value.strip())
    return value.strip() if m and "@" not in m[1] and not _EMAIL.search(value) else None


def _with(node: dict, **changes) -> dict:
    """A copy with each of `changes` applied to the key of that name, where there is one."""
    return {k: changes[k](v) if k in changes else v for k, v in node.items()}


def _if_text(v):
    return _redact(v) if isinstance(v, str) else v


def _scrub_a(record: dict) -> dict:
    """Source A: what ways to apply there are is noted before they go; the external URL stays if it is safe."""
    content = record.get("jobContent")
    if isinstance(content, dict):
        texts = lambda ds: [_with(d, title=_if_text, description=_if_text) if isinstance(d, dict) else d for d in ds] if isinstance(ds, list) else ds
        content = _with(content, externalUrl=_safe_url, jobDescriptions=texts)
        ways = content.get("applyChannel")
        if isinstance(ways, dict):
            has = lambda *names: any(bool(ways.get(n)) for n in names)
            flags = {"apply_via_email": has("emailAddress"), "apply_via_phone": has("phoneNumber"), "apply_via_post": has("rawPostAddress", "postAddress"), "form_url": _safe_url(ways.get("formUrl"))}
            content["applyChannelFlags"] = flags
        record = record | {"jobContent": content}
    return _scrub(record)


def _scrub_b(record: dict) -> dict:
    """Source B: whether there is a contact person is noted before the contact goes; URLs stay if they are safe."""
    about = lambda c: _with(c, description=_if_text) if isinstance(c, dict) else c
    safe = _with(record, url_application=_safe_url, url_description=_safe_url, activity=_if_text, requirements=_if_text, title=_if_text, company=about)
    return _scrub(safe | {"has_contact_person": bool(record.get("contact"))})


def _leaks(node, path: str = "") -> list[str]:
    """Paths of contact keys that hold anything, and of strings with contact data."""
    if isinstance(node, dict):
        out = []
        for k, v in node.items():
            here = f"{path}.{k}" if path else k
            out += [here] if _is_contact(k) and v else _leaks(v, here)
        return out
    if isinstance(node, list):
        return [x for i, v in enumerate(node) for x in _leaks(v, f"{path}[{i}]")]
    if isinstance(node, str) and _scrub(node, path.rsplit(".", 1)[-1]) != node:
        return [path]
    return []


def _walk(s: pd.Series, f) -> list:
    out = []
    for text in s:
        try:
            out.append(f(json.loads(text)) if text is not None else None)
        except ValueError:
            out.append(None)
    return out


@F.pandas_udf(T.StringType())
def scrub_json(s: pd.Series) -> pd.Series:
    """A JSON document without contact keys, its strings redacted; broken JSON gives null.

    A walk over documents of unknown shape: no built-in expression can do that.
    """
    return pd.Series(_walk(s, lambda n: json.dumps(_scrub(n), ensure_ascii=False, separators=(",", ":"))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def contact_leaks(s: pd.Series) -> pd.Series:
    """Paths (a.b[0].c) of contact keys and strings with contact data; broken JSON gives null."""
    return pd.Series(_walk(s, _leaks))


def _typed(f):
    @F.pandas_udf(T.StringType())
    def scrub(s: pd.Series) -> pd.Series:
        return pd.Series(_walk(s, lambda n: json.dumps(f(n), ensure_ascii=False, separators=(",", ":")) if isinstance(n, dict) else None), dtype="object")

    return scrub


# A record of source A or B as JSON, typed scrub; broken JSON and what is no object give null.
scrub_source_a = _typed(_scrub_a)
scrub_source_b = _typed(_scrub_b)


def rescrub(records, json_column: str, *, check: bool = False):
    """records with a JSON column, scrubbed again by the present rules.

    With `check` nothing changes: one row for each record that would, with its leaks.
    """
    done = records.withColumn("__scrubbed", scrub_json(F.col(json_column)))
    if not check:
        return done.withColumn(json_column, F.coalesce("__scrubbed", json_column)).drop("__scrubbed")
    found = done.withColumn("leaks", contact_leaks(F.col(json_column)))
    return found.where(F.size("leaks") > 0).drop("__scrubbed")
