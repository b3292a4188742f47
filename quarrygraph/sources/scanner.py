"""Facts of brace languages by tables of patterns: one reader applies a language's table to each file, on its own.

A pattern is (fact, expression) whose named groups are the row's columns: name, target, detail, and open, where a body
begins whose last line is wanted. Comments are blanked first and offsets stay, so lines are those of the file. What a
match lies in is found afterwards from spans, in a join (operators/joins.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, fact string, name string, target string, detail string, line int, end_line int"
COLUMNS = ["path", "fact", "name", "target", "detail", "line", "end_line"]
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?""", re.S)
_PAIR = {"{": "}", "(": ")", "[": "]"}


def without_comments(text: str) -> str:
    """Comments as blanks, quoted text as it is."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def closing(text: str, at: int) -> int:
    """The offset of the bracket that closes the one at an offset, quotes left aside; the text's end where none does."""
    depth, want = 0, {text[at], _PAIR[text[at]]}
    for m in re.finditer(_TOKEN.pattern + rf"|[{re.escape(''.join(want))}]", text[at:], re.S):
        if m[0] in want:
            depth += 1 if m[0] in _PAIR else -1
            if not depth:
                return at + m.start()
    return len(text)


def scan(path: str, text: str, table: list[tuple[str, re.Pattern]]) -> Iterator[list]:
    bare = without_comments(text)
    starts = [0, *(m.end() for m in re.finditer("\n", bare))]
    index = pd.Index(starts)
    line = lambda at: int(index.searchsorted(at, side="right"))
    for fact, pattern in table:
        for m in pattern.finditer(bare):
            g = m.groupdict()
            at = next((m.start(k) for k in ("name", "target") if g.get(k)), m.start())
            end = line(closing(bare, m.start("open"))) if g.get("open") else line(m.end() - 1 if m.end() > m.start() else m.end())
            yield [path, fact, g.get("name"), g.get("target"), g.get("detail"), line(at), end]


def scanned(files: DataFrame, endings: list[str], table: list[tuple[str, re.Pattern]]) -> DataFrame:
    """Rows of SCHEMA from files (path, text) with one of the endings; a null text is an empty one."""

    def each(batches):
        for pdf in batches:
            rows = [r for path, text in zip(pdf.path, pdf.text, strict=True) for r in scan(path, text, table)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "Int32", "end_line": "Int32"})

    wanted = F.col("path").rlike(r"\.(" + "|".join(endings) + ")$")
    return files.where(wanted).select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, SCHEMA)
