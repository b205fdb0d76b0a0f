"""What a line of a page looks like: structure, place and words, as features of a line classifier (problem 3)."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

_MARK = re.compile(r"(?:[*+-]|\d{1,3}[.)])\s+")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)")
_TARGET = re.compile(r"\]\([^)\s]*\)")
_SPLIT = re.compile(r"\s+[|·•/>»›–—-]\s+|\s{2,}|\t")
_CRUMBS = re.compile(r"\s[>»›/]\s")
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+|[^\w\s]")
_HAN = re.compile(r"[㐀-鿿぀-ヿ가-힯]+")
_LABEL = re.compile(r"(\w[^:：|»>/\n]{0,30}?)\s?(?::(?=\s|$)|：)")
_PROSE_END = re.compile(r"[.!?。！？…:;,，；、\"'”’)]$")
_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: Hashed words; the features that follow them.
WORDS = 1 << 13
SHAPE = [
    "heading", "underline", "table", "fence", "quote", "bold", "list", "link_only", "links_only", "link_and_text", "tiny", "segments2", "segments3",
    "short_segments", "crumbs", "labelled", "label_only", "one_word", "two_words", "six_words", "twelve_words", "more_words", "sentence", "long", "no_space",
    "before_title", "below_title", "first_lines", "last_lines", "near_end", "bias",
]
_AT = {n: WORDS + i for i, n in enumerate(SHAPE)}
SIZE = WORDS + len(SHAPE)

_BODY = frozenset(_AT[k] for k in ("heading", "underline", "table", "fence", "quote", "bold"))
_SHORT = frozenset(_AT[k] for k in ("one_word", "two_words", "six_words"))
_LINKS = frozenset(_AT[k] for k in ("links_only", "link_only"))
#: Non-blank lines that count as a page's first and last ones, and as near its end.
FIRST, LAST, NEAR = 4, 3, 8


def marker(s: str) -> str:
    """The list marker of a stripped line: * - + or 1, else empty."""
    m = _MARK.match(s)
    return "" if not m else ("1" if s[0].isdigit() else s[0])


def key(s: str) -> str:
    """What makes two lines the same: lower case, blanks run together, digits as 0."""
    return _DIGITS.sub("0", _BLANKS.sub(" ", s.lower()).strip())


def tokens(s: str) -> list[str]:
    """Words, numbers as one, and marks of a line; runs of Han, kana and hangul as pairs of letters."""
    out = []
    for w in _WORDS.findall(s.lower()):
        if w[0].isdigit():
            out.append("0")
        elif not w.isascii() and _HAN.search(w):
            for run in _HAN.findall(w):
                out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            out += _HAN.sub(" ", w).split()
        else:
            out.append(w)
    return out


def count_words(s: str, found: list[str]) -> int:
    """How many words the tokens ``found`` of ``s`` stand for: one for each begun 16 letters, and for two Han letters."""
    n = sum((len(w) + 15) // 16 for w in found if w[0].isalnum())
    return n if s.isascii() else n - sum(max(1, len(m) - 1) - (len(m) + 1) // 2 for m in _HAN.findall(s))


def label_of(s: str) -> str:
    """The few words before a colon that a line opens with, else empty."""
    m = _MARK.match(s)
    m = _LABEL.match(s[m.end() :] if m else s)
    return key(m[1]) if m and len(m[1].split()) < 5 else ""


def opening(s: str) -> str:
    """The first two words of a line of at most eleven that doesn't end as a sentence or its part does, else empty."""
    if len(s) > 120 or _PROSE_END.search(s) or _MARK.match(s):
        return ""
    w = tokens(s)
    return " ".join(w[:2]) if 2 < len(w) and count_words(s, w) < 12 else ""


def features(s: str) -> tuple[int, ...]:
    """The features that a stripped line has by itself, as sorted numbers below ``SIZE``."""
    return _features(s) if len(s) > 400 else _remembered(s)


def _features(s: str) -> tuple[int, ...]:
    out = [_AT["bias"]]
    mark = _MARK.match(s)
    body = s[mark.end() :] if mark else s
    if s.startswith("#") and re.match(r"#{1,6}\s", s):
        out.append(_AT["heading"])
    elif s[0] in "=-_*" and len(s) > 2 and not s.strip("=-_* "):
        out.append(_AT["underline"])
    elif s[0] == "|" and s.count("|") > 2:
        out.append(_AT["table"])
    elif s.startswith(("```", "~~~")):
        out.append(_AT["fence"])
    elif s[0] == ">" and s[1:2] in (" ", ""):
        out.append(_AT["quote"])
    elif s.startswith("**"):
        out.append(_AT["bold"])
    if mark:
        out.append(_AT["list"])
    links = _LINK.findall(body) if "](" in body else []
    rest = _LINK.sub("", body).strip(" |·•/>»-–—") if links else body
    if links:
        out.append(_AT["link_and_text" if rest else ("links_only" if len(links) > 1 else "link_only")])
    shown = _TARGET.sub("]", body) if links else body  # where links lead is no text
    words = tokens(shown)
    n = count_words(shown, words)
    ended = bool(_PROSE_END.search(body))
    parts = [p for p in _SPLIT.split(body) if p]
    if len(parts) == 2:
        out.append(_AT["segments2"])
    elif len(parts) > 2:
        out.append(_AT["segments3"])
        if sum(map(len, parts)) / len(parts) < 22:
            out.append(_AT["short_segments"])
        if _CRUMBS.search(body):
            out.append(_AT["crumbs"])
    if label := _LABEL.match(body):
        out.append(_AT["label_only" if label.end() == len(body) else "labelled"])
        out.append(crc32(b"label " + key(label[1]).encode("utf-8", "replace")) % WORDS)
    if n <= 2 and len(body) <= 18 and not ended and not _BODY & set(out):
        out.append(_AT["tiny"])
    out.append(_AT["one_word" if n <= 1 else "two_words" if n == 2 else "six_words" if n <= 6 else "twelve_words" if n <= 12 else "more_words"])
    if ended:
        out.append(_AT["sentence"])
    if n > 18:
        out.append(_AT["long"])
    if " " not in body:
        out.append(_AT["no_space"])
    out += [crc32(w.encode("utf-8", "replace")) % WORDS for w in words]
    return tuple(sorted(set(out)))


_remembered = lru_cache(maxsize=60_000)(_features)


def menu_like(own: tuple[int, ...]) -> bool:
    """Lines whose words name places of a site: one or two words, rows of links or of short segments."""
    f = set(own)
    return not f & _BODY and bool(f & {_AT["tiny"], _AT["links_only"]} or (_AT["short_segments"] in f and _AT["sentence"] not in f and _AT["crumbs"] not in f))


class Page:
    """A page's non-blank lines with their numbers, features and places."""

    __slots__ = ("lines", "numbers", "owns", "code", "title", "underlined")

    def __init__(self, text: str):
        whole = [x.strip() for x in text.split("\n")]
        code = code_lines(whole)
        self.numbers = [k for k, s in enumerate(whole) if s]
        self.lines = [whole[k] for k in self.numbers]
        self.code = [code[k] for k in self.numbers]
        self.owns = [features(s) for s in self.lines]
        rule = _AT["underline"]
        #: Headings that a rule of = or - underlines.
        self.underlined = [
            i + 1 < len(self.lines) and rule in self.owns[i + 1] and self.numbers[i + 1] == self.numbers[i] + 1 and self.lines[i + 1][0] in "=-" and not marker(s) and not self.code[i]
            for i, s in enumerate(self.lines)
        ]
        #: The first heading; or, where long sentences come first, the line above them.
        self.title = -1
        for i, o in enumerate(self.owns):
            if self.underlined[i] or (_AT["heading"] in o and not self.code[i]):
                self.title = i
                break
            if _AT["sentence"] in o and _AT["more_words"] in o and not {_AT["segments2"], _AT["segments3"]} & set(o):
                self.title = i - 1
                break

    def places(self, i: int) -> tuple[int, ...]:
        """The features that a line has by its place in the page."""
        out, n = [], len(self.lines)
        if i < self.title:
            out.append(_AT["before_title"])
        elif i <= self.title + 2:
            out.append(_AT["below_title"])
        if i < FIRST:
            out.append(_AT["first_lines"])
        if i >= n - LAST:
            out.append(_AT["last_lines"])
        if i >= n - NEAR:
            out.append(_AT["near_end"])
        return tuple(out)

    def plain_heading(self, i: int) -> tuple[int, ...]:
        """The features of a heading as if it weren't marked as one; empty for other lines. Titles often stand so."""
        s = self.lines[i].lstrip("# ") if _AT["heading"] in self.owns[i] and not self.code[i] else self.lines[i] if self.underlined[i] else ""
        return features(s) + self.places(i) + ((_AT["before_title"],) if s and i == self.title else ()) if s else ()

    def edge(self, i: int) -> bool:
        """Above the title, within three lines below it, or near the end."""
        return i < self.title + 4 or i >= len(self.lines) - NEAR

    def rim(self, i: int) -> bool:
        """Above the title or at the very end: where a repeated sentence or long line is no note."""
        return i < self.title or i >= len(self.lines) - LAST

    def body(self, i: int) -> bool:
        """Headings, rules, code, tables, quotes and bold notes are content whatever they say."""
        return self.code[i] or self.underlined[i] or not _BODY.isdisjoint(self.owns[i])


class Sample:
    """What the pages of a sample have in common: where their lines stand, the words of their menus, how their rows and short lines open."""

    def __init__(self, pages: list[Page], repeated: set[str], least: int):
        self.least = least
        lines = {(s, o) for p in pages for s, o in zip(p.lines, p.owns)}
        met = Counter(w for s, own in lines if menu_like(own) for w in set(tokens(s)))
        self.names = {w for w, n in met.items() if n > 1}
        self.labels = Counter(x for p in pages for x in {label_of(s) for s in p.lines} if x)
        self.openings = Counter(x for p in pages for x in {opening(s) for i, s in enumerate(p.lines) if p.edge(i) and not p.body(i)} if x)
        at, edge = Counter(), Counter()
        for p in pages:
            for i, (s, own) in enumerate(zip(p.lines, p.owns)):
                if (k := key(s)) in repeated:
                    at[k] += 1
                    edge[k] += p.rim(i) if _AT["more_words"] in own or (_AT["sentence"] in own and not _SHORT & set(own)) else p.edge(i)
        #: Repeated lines that mostly stand above the title, just below it or near the end, as site furniture does; and the others.
        self.outer = {k for k, n in at.items() if edge[k] >= 0.7 * n}
        self.inner = set(at) - self.outer

    def weak_label(self, page: Page, i: int) -> int | None:
        """1 furniture, 0 main content, None where nothing tells."""
        if page.body(i):
            return 0
        f, s = set(page.owns[i]), page.lines[i]
        k = key(s)
        if k in self.outer:
            return 1
        ended = _AT["sentence"] in f
        if menu_like(page.owns[i]) or f & _LINKS or (_AT["short_segments"] in f and not ended):
            return 1
        if not ended and f & {_AT["segments2"], _AT["segments3"]} and self.labels[label_of(s)] >= self.least:
            return 1
        if not ended and 2 < len(w := tokens(s)) < 13 and self.names.issuperset(w):
            return 1
        if page.edge(i) and self.openings[opening(s)] >= self.least:
            return 1
        if k in self.inner:  # furniture amid the text, or a note
            return None if ended or _AT["more_words"] in f else 1
        if ended and f & {_AT["twelve_words"], _AT["more_words"]}:
            return 0
        if f & {_AT["segments3"]} or page.edge(i):
            return None
        return 0


def code_lines(lines: list[str]) -> list[bool]:
    """Which stripped lines are code or its fences. A fence with an info string opens a block even in an open one; one that nothing closes ends at the first blank line."""
    out, begun = [False] * len(lines), -1

    def close_at_blank() -> None:
        for k in range(begun, len(lines)):
            if not lines[k]:
                break
            out[k] = True

    for k, s in enumerate(lines):
        if not s.startswith(("```", "~~~")):
            continue
        if begun >= 0 and not s.strip("`~"):
            out[begun : k + 1] = [True] * (k + 1 - begun)
            begun = -1
        else:
            if begun >= 0:
                close_at_blank()
            begun = k
    if begun >= 0:
        close_at_blank()
    return out


def shape(name: str) -> int:
    return _AT[name]
