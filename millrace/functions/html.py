"""Markup to text, through one parser, in Arrow batches; text without tags is only unescaped there."""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements before which a line breaks, and those that hold no text.
BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "tr"}
HIDDEN = {"script", "style", "noscript", "head"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden = 0 if tag == "body" else self.hidden + (tag in HIDDEN)
        if tag == "li" or tag in BREAKS:
            self.parts.append("\n• " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _whole(found: re.Match) -> bool:
    return found[1] is not None and (found[1][0] == "#" or found[1] in html5)


def _resolved(text: str) -> str:
    """Text with the references that have their semicolon resolved."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if _whole(m) else m[0], text)


def text_of(markup: str, closed: bool = False) -> str:
    """Text with a line for each block that begins, a bullet for each list entry; references that were escaped twice are resolved too.

    A reference without its semicolon is resolved as browsers do; closed: it is text like any other."""
    resolved = _resolved if closed else html.unescape
    if "<" not in markup:
        return " ".join(resolved(markup).split())
    parser = _Text()
    parser.feed(REFERENCE.sub(lambda m: m[0] if _whole(m) else "&amp;" + m[0][1:], markup) if closed else markup)
    parser.close()
    text = re.sub(r"[ \t\r\f\v]+", " ", resolved("".join(parser.parts)))
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", text).strip()


def html_to_text(markup: Column, closed: bool = False) -> Column:
    """Readable text of markup; null gives an empty text. closed: references end in a semicolon, see text_of()."""
    @F.pandas_udf("string")
    def parse(found: pd.Series) -> pd.Series:
        return found.map(lambda m: text_of(m, closed))

    return parse(F.coalesce(markup, F.lit("")))


def json_ld(markup: Column, kind: str = "JobPosting") -> Column:
    """The first JSON-LD block of that type, as JSON text."""
    blocks = F.regexp_extract_all(markup, F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    return F.get(F.filter(blocks, lambda b: F.get_json_object(b, "$.@type") == kind), 0)
