"""Where the headings and paragraphs of a Markdown text begin."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Heading:
    start: int
    level: int
    text: str


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_ATX = re.compile(r"(#{1,6})(?:[ \t]|$)")
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ITEM = re.compile(r"(?:[*+-]|\d{1,9}[.)])(?=[ \t]|$)")
_RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_UNDER = re.compile(r"(=+|-+)[ \t]*$")
_HTML = re.compile(r"<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)


def _indent(s: str) -> int:
    n = 0
    for c in s:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def line_starts(text: str) -> list[int]:
    """0, and what follows each line end, of whichever kind."""
    return [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]


def blocks(text: str) -> tuple[list[Heading], list[int]]:
    """The headings (ATX and setext, not in code) and the starts of paragraphs, also those in quotes and lists.

    A line is stripped of the quotes and list items it stands in; what remains is a fence, code, a rule, a heading, HTML or
    text. A heading's text is its source, an underlined one's with the underline.
    """
    headings: list[Heading] = []
    paragraphs: list[int] = []
    fence = ""  # the open fence
    html = False
    para: int | None = None  # where the open paragraph begins
    quotes = 0
    widths: list[int] = []  # content columns of the open list items
    for m in _LINE.finditer(text):
        line = m[0].rstrip("\r\n")
        at, depth, rest = m.start(), 0, line
        if not rest and m.end() == m.start():
            continue
        while (q := re.match(r" {0,3}> ?", rest)) and not fence:
            depth, rest, at = depth + 1, rest[q.end() :], at + q.end()
        if fence and quotes:
            for _ in range(quotes):
                if q := re.match(r" {0,3}> ?", rest):
                    rest, at = rest[q.end() :], at + q.end()
                else:
                    fence = ""
                    break
        elif depth != quotes and not fence:
            if depth > quotes or not rest.strip() or para is None:
                para = None
                widths = []
            quotes = depth if depth or para is None else quotes
        if fence:
            body = rest.strip()
            if body and set(body) == {fence[0]} and len(body) >= len(fence) and _indent(rest) < 4 + (widths[-1] if widths else 0):
                fence = ""
            continue
        if not rest.strip():
            para, html = None, False
            continue
        if html:
            continue
        depth_in = 0
        for k, w in enumerate(widths):  # open items whose content this line is indented to
            if _indent(rest) >= w:
                depth_in = k + 1
        cut = widths[depth_in - 1] if depth_in else 0
        inner = rest.lstrip(" \t") if cut and _indent(rest) - cut < 4 else (rest[cut:] if cut else rest)
        at += len(rest) - len(inner)
        if depth_in < len(widths) and para is None:
            widths = widths[:depth_in]
        while True:
            plain = inner.lstrip(" \t")
            if _indent(inner) >= 4 and para is None:
                break
            item = _ITEM.match(plain)
            if not item or _RULE.match(plain) or (para is not None and not plain[item.end() :].strip()) or (para is not None and item[0][0].isdigit() and int(item[0][:-1]) != 1 and not widths):
                break
            widths = widths[:depth_in]
            after = plain[item.end() :]
            gap = _indent(after) if 1 <= _indent(after) <= 4 else 1
            widths.append((widths[-1] if widths else 0) + _indent(inner) + item.end() + gap)
            depth_in = len(widths)
            skip = len(inner) - len(plain) + item.end()
            lead = len(after) - len(after.lstrip(" \t")) if after.strip() else 0
            lead = lead if gap == _indent(after) else min(1, lead)
            at, inner, para = at + skip + lead, inner[skip + lead :], None
            if not inner.strip():
                break
        plain = inner.lstrip(" \t")
        if not plain:
            continue
        place = at + len(inner) - len(plain)
        if _indent(inner) >= 4:
            if para is None:
                continue  # indented code
        elif f := _FENCE.match(plain):
            fence, para = f[1] or f[2], None
            continue
        elif h := _ATX.match(plain):
            headings.append(Heading(place, len(h[1]), plain.strip()))
            para = None
            continue
        elif para is not None and (u := _UNDER.match(plain)) and depth == quotes:
            headings.append(Heading(para, 1 if u[1][0] == "=" else 2, text[para : place + len(plain)].strip()))
            if paragraphs and paragraphs[-1] == para:
                paragraphs.pop()
            para = None
            continue
        elif _RULE.match(plain):
            para = None
            continue
        elif para is None and _HTML.match(plain):
            html = True
            continue
        if para is None:
            para = place
            paragraphs.append(place)
    return headings, paragraphs
