"""HTML documents to element rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.frames import frames

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCHEMA = "pos int, depth int, tag string, attributes map<string,string>, text string"


class _Elements(HTMLParser):
    """Collects elements in document order; the text of an element includes that of its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        # Text is kept as a span of one list of chunks, so nesting does not copy it.
        row = [len(self.open), tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, len(self.chunks), None]
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(r[1] == tag for r in self.open):
            while True:
                row = self.open.pop()
                row[4] = len(self.chunks)
                if row[1] == tag:
                    return

    def handle_data(self, data):
        self.chunks.append(data)

    def parse(self, html: str):
        self.chunks = []
        self.feed(html)
        self.close()
        for i, (depth, tag, attrs, start, end) in enumerate(self.rows):
            stop = start if tag in VOID else (len(self.chunks) if end is None else end)
            yield i, depth, tag, attrs, "".join(self.chunks[start:stop])


def html_elements(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row per element: key, pos, depth, tag, attributes, text."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {SCHEMA}"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for k, text in zip(batch[key], batch[html]):
                if text is not None:
                    yield from ((k, *row) for row in _Elements().parse(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(rows(batches), schema)

    return docs.select(key, html).mapInPandas(run, schema)


def elements_by_class(elements: DataFrame, name: str) -> DataFrame:
    return elements.filter(F.try_element_at("attributes", F.lit("class")) == name)


def element_attributes(elements: DataFrame, key: str) -> DataFrame:
    """All attributes of all elements: key, pos, tag, name, value."""
    return elements.select(key, "pos", "tag", F.explode("attributes").alias("name", "value"))
