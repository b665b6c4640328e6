"""Plain text of web pages, by regular expressions that look at no part of a page again and again: a tag ends before the
next `<`, quantifiers don't give back, and an element without an end is taken to the end of the page once."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(?P<t>script|style|noscript|template)\b.*?(?:</(?P=t)\s*+>|\Z)")
_SIDE = re.compile(r"(?is)<(?P<t>nav|footer|header|aside|form)\b.*?(?:</(?P=t)\s*+>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|title|head|body|blockquote|pre|hr|dd|dt)\b[^<>]*+>")
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*+>")
_HTML = re.compile(r"(?i)<html\b[^<>]*+>")
_LANG = re.compile(r"(?is)(?<=[\s\"'/])lang\s*+=\s*+[\"']?+\s*+([a-z]{2,3})\b")
_TITLE, _TITLE_END = re.compile(r"(?i)<title\b[^<>]*+>"), re.compile(r"(?i)</title\s*+>")
_LINK = re.compile(r"(?i)<a\b[^<>]*+>")
_HREF = re.compile(r"(?i)(?<=[\s\"'/])href\s*+=")


def plain(page: str | None, *, main_only: bool = False) -> str:
    """The text of a page, a line for each block; null gives an empty text. main_only leaves navigation and footers out."""
    x = _DROP.sub(" ", page or "")
    if main_only:
        x = _SIDE.sub(" ", x)
    x = html.unescape(_TAG.sub("", _BLOCK.sub("\n", x)))
    lines = (" ".join(line.split()) for line in x.split("\n"))
    return "\n".join(line for line in lines if line)


def declared_language(page: str | None) -> str | None:
    """The language that the first html tag outside comments declares, wherever it stands."""
    for tag in _HTML.finditer(_COMMENT.sub(" ", page or "")):
        got = _LANG.search(tag[0])
        if got:
            return got[1].lower()
    return None


def title(page: str | None) -> str:
    start = _TITLE.search(page or "")
    end = start and _TITLE_END.search(page, start.end())
    return " ".join(html.unescape(page[start.end() : end.start()]).split()) if end else ""


def links(page: str | None) -> int:
    """How many anchors have an address."""
    return sum(1 for tag in _LINK.finditer(page or "") if _HREF.search(tag[0]))
