"""Facts of brace languages by rules over tokens: a file becomes words, quoted texts and signs, and a rule is a run of steps over them.

A step takes the tokens, a place and what was named so far, and gives the places where the next step may go on. What a
rule names becomes the row's columns: name, target, detail; and open, a bracket whose partner's line is the fact's last.
Comments are no tokens, brackets know their partners, so a rule steps over a whole list of arguments at once. What a fact
lies in is found afterwards from spans, in a join (operators/joins.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.sources.scanner import COLUMNS, SCHEMA

_SPLIT = re.compile(r"""(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<word>[\w$]+)|(?P<sign>=>|->|::|.)""", re.S)
_PARTNER = {")": "(", "]": "[", "}": "{"}
#: Tokens that a step looks ahead at most.
AHEAD = 200


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int
    leads: bool
    start: int
    mate: int | None = None


def tokens(text: str) -> list[Token]:
    """A file's tokens; leads: the first of its line; mate: the place of a bracket's partner. Of a quoted text the quotes go."""
    out, line, begun, leads, open_ = [], 1, 0, True, {s: [] for s in "([{"}
    for m in _SPLIT.finditer(text):
        kind, said = m.lastgroup, m[0]
        if kind != "gap":
            inner = said[1:-1] if kind == "quoted" and len(said) > 1 and said[-1] == said[0] else said[1:] if kind == "quoted" else said
            t = Token(kind, inner, line, m.start() - begun, leads, m.start())
            if said in open_:
                open_[said].append(len(out))
            elif (near := open_.get(_PARTNER.get(said, ""))) and kind == "sign":
                t.mate = near.pop()
                out[t.mate].mate = len(out)
            out.append(t)
            leads = False
        if (breaks := said.count("\n")) > 0:
            line, begun, leads = line + breaks, m.start() + said.rindex("\n") + 1, True if kind == "gap" else leads
    return out


Step = Callable[[list[Token], int, dict], Iterator[tuple[int, dict]]]


def _one(fits: Callable[[Token], bool], into: str | None) -> Step:
    def step(ts, i, named):
        if i < len(ts) and fits(ts[i]):
            yield i + 1, named if into is None else named | {into: ts[i].text, f"at {into}": ts[i].line}

    return step


def word(*some: str, into: str | None = None) -> Step:
    """A word: any, or one of some."""
    return _one((lambda t: t.kind == "word" and t.text in some) if some else (lambda t: t.kind == "word" and not t.text[0].isdigit()), into)


def sign(*some: str, into: str | None = None) -> Step:
    return _one(lambda t: t.kind == "sign" and t.text in some, into)


def quoted(into: str | None = None, like: str = r"(?s).+") -> Step:
    return _one(lambda t: t.kind == "quoted" and re.fullmatch(like, t.text) is not None, into)


def leading(column: int | None = None) -> Step:
    """The next token is the first of its line, at a column if one is given."""

    def step(ts, i, named):
        if i < len(ts) and ts[i].leads and column in (None, ts[i].column):
            yield i, named

    return step


def dotted(into: str, last: tuple[str, ...] = (), fresh: bool = True) -> Step:
    """Words joined by dots, to the last of them; fresh: no dot stands in front; last: words of which the last is one."""

    def step(ts, i, named):
        if i < len(ts) and ts[i].kind == "word" and not (fresh and i and ts[i - 1].text == "."):
            j = i + 1
            while j + 1 < len(ts) and ts[j].text == "." and ts[j].kind == "sign" and ts[j + 1].kind == "word":
                j += 2
            if not last or ts[j - 1].text in last:
                yield j, named | {into: "".join(t.text for t in ts[i:j]), f"at {into}": ts[i].line}

    return step


def either(*ways: tuple[Step, ...]) -> Step:
    def step(ts, i, named):
        for way in ways:
            yield from run(way, ts, i, named)

    return step


def perhaps(*steps: Step) -> Step:
    """The steps if they fit, else none of them."""
    return either(steps, ())


def whole(bracket: str) -> Step:
    """A bracket with all that is in it."""

    def step(ts, i, named):
        if i < len(ts) and ts[i].kind == "sign" and ts[i].text == bracket and ts[i].mate is not None:
            yield ts[i].mate + 1, named

    return step


def upto(*stops: str, into: str | None = None, never: tuple[str, ...] = (";",)) -> Step:
    """On to the next of stops, which stays; none of never lies between. into: the text between."""

    def step(ts, i, named):
        for j in range(i, min(len(ts), i + AHEAD)):
            if ts[j].kind != "quoted" and ts[j].text in stops:
                between = "".join(t.text + " " * (t.kind == after.kind == "word") for t, after in pairwise(ts[i : j + 1]))
                yield j, named if into is None else named | {into: between}
                return
            if ts[j].kind != "quoted" and ts[j].text in never:
                return

    return step


def last_argument(into: str) -> Step:
    """On to the bracket that ends the arguments; into: the last of them if it is words joined by dots."""

    def step(ts, i, named):
        j = i
        while j < len(ts) and ts[j].text not in _PARTNER:
            j = ts[j].mate + 1 if ts[j].kind == "sign" and ts[j].mate is not None else j + 1
        k = j
        while k > i and ts[k - 1].kind == "word" and (k == j or ts[k].text == "."):
            k -= 1 + (ts[k - 2].text == "." and k - 2 > i)
        said = "".join(t.text for t in ts[k:j]).strip(".")
        yield j, named | {into: said} if said and ts[k - 1].text == "," else named

    return step


def opened() -> Step:
    """The brace that begins a body."""

    def step(ts, i, named):
        if i < len(ts) and ts[i].kind == "sign" and ts[i].text == "{":
            yield i + 1, named | {"open": i}

    return step


def run(steps: tuple[Step, ...], ts: list[Token], i: int, named: dict) -> Iterator[tuple[int, dict]]:
    """All ways in which the steps fit from a place on."""
    if not steps:
        yield i, named
        return
    for j, more in steps[0](ts, i, named):
        yield from run(steps[1:], ts, j, more)


Rule = tuple[str, tuple[Step, ...]]


def found(path: str, text: str, rules: list[Rule]) -> Iterator[list]:
    ts = tokens(text)
    for i in range(len(ts)):
        for fact, steps in rules:
            hit = next(run(steps, ts, i, {}), None)  # the first way counts
            if hit is not None:
                j, named = hit
                begin = next((named[f"at {k}"] for k in ("name", "target") if f"at {k}" in named), ts[i].line)
                last = j - 1
                if "open" in named:
                    last = ts[named["open"]].mate if ts[named["open"]].mate is not None else len(ts) - 1
                yield [path, fact, named.get("name"), named.get("target"), named.get("detail"), begin, ts[last].line]


def matched(files: DataFrame, endings: list[str], rules: list[Rule]) -> DataFrame:
    """Rows of scanner.SCHEMA from files (path, text) with one of the endings; a null text is an empty one."""

    def each(batches):
        for pdf in batches:
            rows = [r for path, text in zip(pdf.path, pdf.text, strict=True) for r in found(path, text, rules)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "Int32", "end_line": "Int32"})

    wanted = F.col("path").rlike(r"\.(" + "|".join(endings) + ")$")
    return files.where(wanted).select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, SCHEMA)
