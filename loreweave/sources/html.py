"""HTML to text with the standard library, as an Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..rules import KOREAN, RulePack

_HIDDEN = {"script", "style", "template"}
#: How an image with a description is written (fixed value).
IMAGE = "[이미지: %s]"


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _whole_references(html: str) -> str:
    """Ampersands that begin no whole reference as references, so that a name cut off before its semicolon stays as it is."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "img" and (alt := dict(attrs).get("alt")):
            self.parts.append(IMAGE % alt)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "img":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := data.strip()):
            self.parts.append(text)


def visible_text(html: str | None) -> str:
    """Text nodes one a line; images by their description; scripts, styles and comments left out; references end in a semicolon."""
    parser = _Text()
    parser.feed(_whole_references(html or ""))
    parser.close()
    return "\n".join(parser.parts)


def _visible(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for page in pages:
        yield page.map(visible_text)


def html_to_text(html: Column, rules: RulePack = KOREAN) -> Column:
    """Normalised text of an HTML column; null gives an empty text."""
    return normalize_text(F.pandas_udf(_visible, "string")(html), rules)
