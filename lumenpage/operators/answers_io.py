"""Small tools at the edges: JSON in free text, safe URLs, printable text, lists of URLs."""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpage.functions.text import PRINT_MARKS, UI_MARKS
from lumenpage.functions.urls import normalize_url

# Ports and hosts that a page fetch may or may not use.
PORTS = (80, 443, 8080, 8443)
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata")
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost")


def first_json(text: str | None) -> str | None:
    """The first JSON object in a text, fenced or among prose, as compact JSON; None without one."""
    t = re.sub(r"```(?:json)?", "", text or "")
    for at in (m.start() for m in re.finditer(r"\{", t)):
        try:
            found, _ = json.JSONDecoder().raw_decode(t[at:])
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
    return None


def unsafe_reason(url: str | None) -> str:
    """Why a URL must not be fetched; the empty text if it may. Names are not resolved here."""
    from urllib.parse import urlsplit

    u = (url or "").strip()
    if not u:
        return "empty"
    if len(u) > 2048:
        return "too long"
    try:
        p = urlsplit(u)
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return "malformed"
    if p.scheme not in ("http", "https"):
        return "scheme"
    if not host:
        return "no host"
    if p.username or p.password:
        return "credentials"
    if port is not None and port not in PORTS:
        return "port"
    if host in BLOCKED_HOSTS or host.endswith(BLOCKED_SUFFIXES):
        return "internal host"
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return ""
    bad = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    return "internal address" if bad else ""


def printable(text: str | None) -> str:
    """Text for a Latin-1 printer: dashes, arrows and quotes replaced, decomposed, the rest dropped."""
    t = text or ""
    for a, b in {**UI_MARKS, **PRINT_MARKS}.items():
        t = t.replace(a, b)
    t = unicodedata.normalize("NFKD", t).encode("latin-1", "ignore").decode("latin-1")
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t)


def arrow_column(f, c: Column) -> Column:
    """A text function of this module over a column, in Arrow batches."""

    def over(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(over, "string")(c)


def url_lines(c: Column) -> Column:
    """The URLs of a text, parted by white space or commas, made normal, each once in order."""
    raw = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,]+"), lambda x: x != "")
    return F.array_distinct(F.transform(raw, lambda u: normalize_url(u)))


def competitor_lines(c: Column) -> Column:
    """array of struct<name, domain> from lines "Name, domain"."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    part = lambda x, i: F.trim(F.coalesce(F.get(F.split(x, ",", 2), F.lit(i)), F.lit("")))
    return F.transform(lines, lambda x: F.struct(part(x, 0).alias("name"), part(x, 1).alias("domain")))
