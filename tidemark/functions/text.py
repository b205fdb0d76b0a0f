"""Strings: converted pages, content types, file names, durations, search terms."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type labels by file suffix and by content type, and the suffix a body of a content type is stored with.
SUFFIX_LABELS = {
    ".htm": "html", ".html": "html", ".ipynb": "jupyter-notebook", ".markdown": "markdown", ".md": "markdown",
    ".pdf": "pdf", ".py": "python", ".rst": "rst", ".txt": "text",
}
CONTENT_TYPE_LABELS = {
    "application/json": "json", "application/pdf": "pdf", "application/xml": "xml", "text/html": "html",
    "text/markdown": "markdown", "text/plain": "text", "text/x-python": "python", "text/xml": "xml",
}
CONTENT_TYPE_SUFFIXES = {
    "text/html": ".html", "text/markdown": ".md", "text/plain": ".txt", "application/xml": ".xml", "text/xml": ".xml",
    "text/x-python": ".py", "application/json": ".json", "application/pdf": ".pdf",
}

#: Device names that a file can't have on Windows; length of a stem and of its hash.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]
STEM, HASH = 180, 12

#: English words that a search ignores.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves"
).split()


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def finish_markdown(text: Column, title: Column) -> Column:
    """Converted text as a document: trimmed, headed by its title unless it begins so, form feeds as rules."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    head = F.concat(F.lit("# "), title)
    whole = F.when(title.isNull() | F.startswith(body, head), body).otherwise(F.concat(head, F.lit("\n\n"), body))
    return F.replace(whole, F.lit("\f"), F.lit("\n\n---\n\n"))


def content_type(value: Column) -> Column:
    """A content type without parameters, trimmed and in lower case."""
    return F.lower(F.trim(F.split(value, ";", 2)[0]))


def suffix(path: Column) -> Column:
    """The last .suffix of a path's last part, in lower case; null without one."""
    found = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.when(found != "", F.lower(found))


def type_label(path: Column, kind: Column) -> Column:
    """A source's type: by its suffix, else by its content type, else null."""
    return F.coalesce(_lookup(suffix(path), SUFFIX_LABELS), _lookup(content_type(kind), CONTENT_TYPE_LABELS))


def body_suffix(path: Column, kind: Column) -> Column:
    """The suffix a fetched body is stored with: by content type, else as in the path, else .bin."""
    return F.coalesce(_lookup(content_type(kind), CONTENT_TYPE_SUFFIXES), suffix(path), F.lit(".bin"))


def extension(value: Column) -> Column:
    """File extensions in one form: a dot before each part, letters, digits, _ and - only, lower case; null if nothing is left."""
    parts = F.filter(F.transform(F.split(F.trim(value), r"\."), lambda p: F.lower(F.regexp_replace(p, "[^A-Za-z0-9_-]+", ""))), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("."), F.array_join(parts, ".")))


def cache_stem(key: Column) -> Column:
    """A visible and safe file stem of a key (of ASCII; other letters count as unsafe)."""
    v = F.replace(key, F.lit("://"), F.lit("__"))
    v = F.regexp_replace(v, r"[\\/]", "_")
    v = F.regexp_replace(v, "[^A-Za-z0-9._-]+", "_")
    v = F.regexp_replace(v, r"^[ ._]+|[ ._]+$", "")
    v = F.when(v == "", "entry").otherwise(v)
    v = F.when(F.upper(F.split(v, r"\.")[0]).isin(RESERVED), F.concat(F.lit("_"), v)).otherwise(v)
    head, tail = STEM // 2 - 2, STEM - STEM // 2
    short = F.concat(F.substring(v, 1, head), F.lit(".."), F.substring(v, -tail, tail))
    return F.when(F.length(v) > STEM, short).otherwise(v)


def cache_key(key: Column) -> Column:
    """The stem, and twelve digits of the key's SHA-256."""
    return F.concat_ws("--", cache_stem(key), F.substring(F.sha2(key, 256), 1, HASH))


def seconds(value: Column) -> Column:
    """Durations such as 1m0.612s, 350ms or 2h as seconds; null for anything else."""
    part = lambda unit: F.coalesce(F.try_element_at(F.regexp_extract_all(value, F.lit(rf"([0-9.]+){unit}"), F.lit(1)), F.lit(1)).cast("double"), F.lit(0.0))
    total = part("h") * 3600 + part("m(?!s)") * 60 + part("s") + part("ms") / 1000
    return F.when(value.rlike(r"^(?:[0-9.]+(?:h|ms|m|s))+$"), total)


def content_hash(text: Column) -> Column:
    """The SHA-256 of a text, that of an empty one for null."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def prompted(prefix: str | None, text: Column) -> Column:
    """A text with the prompt of its kind before it."""
    return F.concat(F.lit(prefix), text) if prefix else text


def terms(text: Column) -> Column:
    """Search terms without stemming: lower case, split at all but a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


_VOWELS = "aeiou"


def stem(word: str) -> str:
    """English words by their stem, after the published rules of Porter (1980)."""
    if len(word) < 3 or not word.isascii():
        return word

    def shape(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            vowel = c in _VOWELS or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    measure = lambda w: len(re.findall("v+c+", shape(w)))
    has_vowel = lambda w: "v" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"
    short = lambda w: shape(w).endswith("cvc") and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + new if measure(base) >= least else w
        return w

    w = swap(word, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], 0)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    second = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    third = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for rules in (second, third):
        w = swap(w, [tuple(r.split(":")) for r in rules.split()], 1)
    for end in "ement ment ent ance ence able ible ant al er ic ism ate iti ous ive ize ion ou".split():
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


_PLAIN = re.compile(r"[^a-z0-9]+")


def analyse(text: str | None) -> list[str]:
    """Search terms of English text: no accents, lower case, no stop words, stemmed."""
    flat = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return [stem(t) for t in _PLAIN.split(flat) if t and t not in _STOP]


_STOP = frozenset(STOP_WORDS)
