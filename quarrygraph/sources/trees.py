"""Tolerant reading of XML-like documents: one row for each element that carries an id."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc string, id string, type string, name string, parent string, top boolean, text string"

#: Elements that only hold others, and attributes whose values count as text.
CONTAINERS = {"page", "canvas", "document", "figjam", "file", "root", "board", "nodes"}
TEXT_ATTRIBUTES = ("name", "text", "characters", "label", "title", "content", "value")
ID_ATTRIBUTES = ("id", "nodeid", "node-id")

#: Elements after which a task hands on what it has read.
PIECE = 1_000


class _Reader(HTMLParser):
    """Keeps the open elements; an end tag without a start is ignored, one that skips open elements closes them."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.rows: dict[str, dict] = {}

    def say(self, parts: list[str]) -> None:
        for _, key in self.open:
            if key:
                self.rows[key]["text"].extend(parts)

    def element(self, tag: str, attrs) -> str | None:
        has = {k: v for k, v in attrs if v}
        key = next((has[a] for a in ID_ATTRIBUTES if a in has), None)
        if key is None:
            return None
        holder = next(((t, k) for t, k in reversed(self.open) if k), None)
        kind = has.get("type", tag).upper()
        is_page = lambda k: k in ("PAGE", "CANVAS", "DOCUMENT")
        high = holder is None or holder[0] in CONTAINERS or is_page(self.rows[holder[1]]["type"])
        said = [has[a] for a in TEXT_ATTRIBUTES if a in has]
        self.rows[key] = {"id": key, "type": kind, "name": has.get("name", ""), "parent": holder and holder[1], "top": high and not is_page(kind), "text": list(said)}
        self.say(said)
        return key

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, self.element(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.element(tag, attrs)

    def handle_endtag(self, tag):
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if data.strip():
            self.say([data.strip()])


def read(text: str) -> list[dict]:
    reader = _Reader()
    reader.feed(text)
    reader.close()
    return [{**r, "text": " ".join(r["text"])} for r in reader.rows.values()]


def _elements(batches):
    rows = []
    frame = lambda: pd.DataFrame(rows, columns=["doc", "id", "type", "name", "parent", "top", "text"])
    for pdf in batches:
        for doc, text in zip(pdf.doc, pdf.text):
            rows += [{"doc": doc, **r} for r in read(text)]
            if len(rows) >= PIECE:
                yield frame()
                rows = []
    yield frame()


def elements(docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA from docs (doc, text); text of an element is that of all below it. Of repeated ids in a document the last stays.

    A task holds the rows of PIECE elements and one document, however many documents a batch has.
    """
    return docs.select("doc", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_elements, SCHEMA)
