"""Addresses: one spelling, scopes, patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import unquote, urldefrag, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ports that an address of a scheme doesn't name.
PORTS = {"http": 80, "https": 443}


def canonical_url(target: str | None, base: str | None = None) -> str | None:
    """One spelling of a web address: joined to its base, no fragment, scheme and host in lower case, no default port, no lone slash.

    Queries and user names stay. Null for other schemes, and for addresses without host or with an impossible port.
    """
    if not (whole := urljoin(base, target or "") if base else target):
        return None
    try:
        at = urlsplit(urldefrag(whole)[0])
        port = at.port
    except ValueError:
        return None
    if at.scheme.lower() not in PORTS or not at.netloc:
        return None
    host = at.hostname or ""
    host = f"[{host}]" if ":" in host else host
    user = at.netloc.rpartition("@")[0]
    place = (f"{user}@" if user else "") + host + (f":{port}" if port not in (None, PORTS[at.scheme.lower()]) else "")
    return urlunsplit((at.scheme.lower(), place, "" if at.path == "/" else at.path, at.query, ""))


def find_target(target: str, base: str | None = None) -> str:
    """An address as link searches keep it: joined, without fragment; file addresses as plain paths."""
    whole = urldefrag(urljoin(base, target) if base else target)[0]
    if urlsplit(whole).scheme == "file":
        return file_path(whole)
    return canonical_url(whole) or whole


def file_path(uri: str) -> str:
    """The path of a file: URI; a drive letter loses the slash before it."""
    at = urlsplit(uri)
    path = unquote(at.path)
    if at.netloc and at.netloc != "localhost":
        path = f"//{at.netloc}{path}"
    return path[1:] if re.match(r"/[A-Za-z]:", path) else path


def file_uri(path: str) -> str:
    return Path(path).resolve().as_uri()


def canonical_absolute(url: Column) -> Column:
    """:func:`canonical_url` of absolute addresses as columns."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1)
    rest = F.regexp_extract(bare, "^[^:]+://[^/?]*(.*)$", 1)
    user = F.regexp_extract(place, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(place, "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    host = F.regexp_replace(host, ":$", "")
    rest = F.when(rest == "/", "").otherwise(F.regexp_replace(rest, r"^/\?", "?"))
    return F.when(scheme.isin(*PORTS) & (place != ""), F.concat(scheme, F.lit("://"), user, host, rest))


def origin_key(url: Column) -> Column:
    """struct(scheme, host, port) with the scheme's port where none is named."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_extract(url, "^[^:]+://([^/?#]*)", 1), "^.*@", "")
    port = F.regexp_extract(place, r":(\d+)$", 1)
    known = F.when(scheme == "http", 80).when(scheme == "https", 443)
    named = F.when(port != "", port.cast("int")).otherwise(known)
    return F.struct(scheme.alias("scheme"), F.lower(F.regexp_replace(place, r":\d*$", "")).alias("host"), named.alias("port"))


def in_scope(url: Column, scope: Column, *, external: bool = False, subdomains: bool = False) -> Column:
    """Whether an address lies in a scope's origin, or on a subdomain of its host, or anywhere."""
    if external:
        return F.lit(True)
    a, b = origin_key(url), origin_key(scope)
    same = (a["scheme"] == b["scheme"]) & (a["port"] == b["port"])
    hosts = a["host"] == b["host"]
    if subdomains:
        hosts = hosts | F.endswith(a["host"], F.concat(F.lit("."), b["host"]))
    return same & hosts


def redirect_host(url: Column) -> Column:
    """The host without www., by which a seed and what it redirects to are one."""
    return F.regexp_replace(origin_key(url)["host"], r"^www\.", "")


def glob_regex(pattern: str) -> str:
    """A glob as regular expression: * within a path part, ** across parts, /** also for the bare parent."""
    out = []
    for piece in re.split(r"(/\*\*|\*\*|\*)", pattern):
        out.append({"/**": "(?:/.*)?", "**": ".*", "*": "[^/]*"}.get(piece) or re.escape(piece))
    return "".join(out)


Pattern = str | re.Pattern


def matches(value: Column, include: Sequence[Pattern] = (), exclude: Sequence[Pattern] = ()) -> Column:
    """Patterns over a column: excluded ones never match; without included ones all others do. Strings are globs, compiled ones are searched for."""

    def one(p: Pattern) -> Column:
        return value.rlike(p.pattern if isinstance(p, re.Pattern) else f"^(?:{glob_regex(p)})$")

    keep = F.lit(not include)
    for p in include:
        keep = keep | one(p)
    for p in exclude:
        keep = keep & ~one(p)
    return keep


def matches_types(label: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Type labels: an excluded one never matches; an unknown one only where none is asked for."""
    low = F.lower(label)
    keep = F.coalesce(low.isin(*map(str.lower, include)), F.lit(False)) if include else F.lit(True)
    return keep & ~F.coalesce(low.isin(*map(str.lower, exclude)), F.lit(False)) if exclude else keep
