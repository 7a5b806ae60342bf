"""The readable text of scraped pages: dropped subtrees, then the main part of what is left."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subtrees without readable text, and those that are left out of a page's main text besides.
SILENT = frozenset({"script", "style", "noscript"})
AROUND = frozenset({"nav", "footer"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The main part is the first element of the first of these kinds that the page has.
KINDS = ("main", "article", "content class", "content id", "body")


class _Reader(HTMLParser):
    """Gathers runs of text with the span of runs that the first element of each kind covers. Dropped elements are passed
    over as a whole. Each tag is handled once; closing one looks for its name among the open elements."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.runs, self.buffer = dropped, [], []
        self.open: list[tuple[str, list[str]]] = []  # names, and the kinds that began here
        self.depth: dict[str, int] = {}
        self.silent = 0
        self.spans: dict[str, list[int]] = {}

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if text:
            self.runs.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in VOID:
            return
        if self.silent or tag in self.dropped:
            self.silent += 1
            kinds = []
        else:
            values = dict(attrs)
            is_kind = (tag == "main", tag == "article", "content" in (values.get("class") or "").split(), values.get("id") == "content", tag == "body")
            kinds = [k for k, there in zip(KINDS, is_kind) if there and k not in self.spans]
            self.spans.update({k: [len(self.runs), -1] for k in kinds})
        self.open.append((tag, kinds))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if self.depth.get(tag):
            while self.close_one() != tag:
                pass

    def close_one(self) -> str:
        tag, kinds = self.open.pop()
        self.depth[tag] -= 1
        self.silent = max(0, self.silent - 1)
        for k in kinds:
            self.spans[k][1] = len(self.runs)
        return tag

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self) -> str:
        self.flush()
        while self.open:
            self.close_one()
        first, end = next((self.spans[k] for k in KINDS if k in self.spans), (0, len(self.runs)))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(self.runs[first:end]))


def readable(html: str | None, main_only: bool = True) -> str:
    """The texts of a page between tags, stripped, one a line: of its first main element, else of the first article, the
    first element of class content, the one with id content, the body, or all. Scripts, styles and noscript go first, with
    main_only also nav and footer. An empty or null page has no text."""
    reader = _Reader(SILENT | AROUND if main_only else SILENT)
    reader.feed(html or "")
    reader.close()
    return reader.text()


def main_text(html: Column, main_only: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: readable(x, main_only))

    return run(html)


def main_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, text for every page."""
    return pages.select(key, main_text(F.col(html)).alias("text"))
